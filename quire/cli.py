"""python -m quire.cli VERB ...: conversion, corpus runs, evaluation and checks from a shell."""

from __future__ import annotations

import argparse
import json
import os
import sys

from quire.functions import checks as K, compile as C, decode as D
from quire.functions.render import launcher, render
from quire.sources import runs


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quire").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def main(argv: list[str] | None = None) -> int:
    """0 if all is well, 1 if something needs a look, 2 for wrong use."""
    top = argparse.ArgumentParser(prog="quire")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *positional: str, **options) -> None:
        p = verbs.add_parser(name)
        for arg in positional:
            p.add_argument(arg, nargs="*" if arg.endswith("s") else None)
        p.add_argument("--config", action="append", default=[], help="a settings file; later ones win")
        for arg, default in options.items():
            p.add_argument("--" + arg.replace("_", "-"), default=default)

    verb("convert", "page", out=None)
    verb("scan", "source", "output")
    verb("run", "source", "output", corpus=None)
    verb("eval", "produced", "reference")
    verb("diff", "produced", "reference", class_prefix="", severity="")
    verb("validate", "documents")
    verb("render", "documents", out="rendered")
    verb("inspect", "page")
    verb("config")
    a = top.parse_args(argv)
    config, origin = runs.load_config(*a.config)
    if a.verb == "config":
        print("\n".join(f"{k} = {getattr(config, k)!r}  ({origin[k]})" for k in origin))
        return 0
    if a.verb in ("convert", "inspect"):
        with open(a.page, "rb") as file:
            found = D.decide(file.read())
        made = C.convert(found["text"], runs.options_of(config))
        made["ledger"] = [{"node": n, "terminal": t, "note": w} for n, t, w in made["ledger"]]
        gate = K.verify(made, config.min_recall, config.max_line, runs.options_of(config).target.rules())
        if a.verb == "inspect":
            print(json.dumps({**{k: found[k] for k in ("codec", "source", "declared", "uncertain")}, **gate, "tables": made["tables"], "ledger": made["ledger"]}, ensure_ascii=False, indent=1))
        elif a.out:
            with open(a.out, "w", encoding="utf-8") as file:
                file.write(made["markdown"])
        else:
            sys.stdout.write(made["markdown"])
        return int(gate["state"] == "review-required")
    if a.verb == "validate":
        rows = [(d, code, severity, path) for d in a.documents for code, severity, path in K.validate(_text(d), **runs.options_of(config).target.rules())]
        rows += [(d, code, "warning" if code == "line-too-long" else "error", f"line {n}") for d in a.documents for code, n in K.lint(_text(d), config.max_line)]
        print("\n".join("\t".join(r) for r in rows))
        return int(any(r[2] == "error" for r in rows))
    if a.verb == "render":
        os.makedirs(a.out, exist_ok=True)
        names = [os.path.basename(d).removesuffix(".md") for d in a.documents]
        for name, d in zip(names, a.documents):
            with open(os.path.join(a.out, name + ".html"), "w", encoding="utf-8") as file:
                file.write(render(_text(d), name))
        with open(os.path.join(a.out, "index.html"), "w", encoding="utf-8") as file:
            file.write(launcher(names))
        return 0
    spark = _session()
    from pyspark.sql import functions as F

    from quire.operators import documents as Docs
    from quire.sources import files as S

    if a.verb == "scan":
        profile = runs.corpus_scan(spark, a.source, a.output, config)
        print("\n".join(f"{name}\t{table.count()}" for name, table in profile.items()))
        return 0
    if a.verb == "run":
        made = runs.corpus_run(spark, a.source, a.output, config, a.corpus)
        states = {r["state"]: r["count"] for r in made.groupBy("state").count().collect()}
        print("\n".join(f"{k}\t{v}" for k, v in sorted(states.items())))
        return int("review-required" in states)
    pairs = S.pair(S.documents(spark, a.produced), S.documents(spark, a.reference)).withColumn("doc", F.xxhash64("stem"))
    if a.verb == "eval":
        scores = Docs.overall_scores(pairs, "doc", "reference", "produced").join(pairs.select("doc", "stem"), "doc")
        for r in scores.orderBy("stem").toLocalIterator():
            print(f"{r.stem}\t{100 * r.overall:.1f}\t{100 * r['shape']:.1f}")
        mean = Docs.corpus_score(scores).first()
        print(f"all {mean.documents}\t{100 * (mean.mean or 0):.1f}")
        return 0
    found = Docs.diff_documents(pairs, "doc", "produced", "reference").where(F.col("class").startswith(a.class_prefix) & (F.lit(a.severity).isin("") | (F.col("severity") == a.severity)))
    n = 0
    for r in found.join(pairs.select("doc", "stem"), "doc").orderBy("stem", "path").toLocalIterator():
        n += 1
        print("\t".join(str(x or "") for x in (r.stem, r.severity, r["class"], r.path, r.produced, r.reference)))
    return int(n > 0)


if __name__ == "__main__":
    raise SystemExit(main())
