"""Configuration, and runs over directories that can be resumed."""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions import compile as C, decode as D
from quire.functions.profiles import PROFILES, TargetProfile
from quire.operators import decisions as B
from quire.plans import convert as P
from quire.sources import files as S

ENGINE = "1"


@dataclass(frozen=True)
class Config:
    """Settings of a run; later layers win: defaults, user file, project file, environment, arguments."""

    profile: str = "default"
    chrome_threshold: float = 0.7
    min_recall: float = 0.995
    max_line: int = 2200
    max_calls: int = 1000
    max_input_tokens: int = 1_000_000
    max_output_tokens: int = 200_000
    target: str = "default"  # what the renderer can do: a name of profiles.PROFILES
    columns: bool = True  # keep lanes side by side
    sections: bool = True  # look for section labels


def load_config(*paths: str, env: dict[str, str] | None = None, **arguments) -> tuple[Config, dict[str, str]]:
    """(config, where each value is from).  Files are JSON in which // and /* */ comments may stand; unknown keys are errors."""
    known = {f.name: f.type for f in fields(Config)}
    values, origin = asdict(Config()), dict.fromkeys(known, "default")
    layers: list[tuple[str, dict]] = [(p, json.loads(strip_comments(open(p, encoding="utf-8").read()))) for p in paths if os.path.exists(p)]
    env = os.environ if env is None else env
    layers.append(("environment", {k: env[f"QUIRE_{k.upper()}"] for k in known if f"QUIRE_{k.upper()}" in env}))
    layers.append(("arguments", {k: v for k, v in arguments.items() if v is not None}))
    for name, layer in layers:
        for key, value in layer.items():
            if key not in known:
                raise ValueError(f"unknown setting {key!r} in {name}")
            values[key], origin[key] = _as(type(values[key]), value), name
    return Config(**values), origin


def _as(kind: type, value):
    """A setting's value as its type; words for truth values."""
    if kind is bool and isinstance(value, str):
        if value.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"{value!r} is neither true nor false")
        return value.lower() in ("true", "1", "yes")
    return kind(value)


def strip_comments(text: str) -> str:
    """JSON without its comments; strings are left alone."""
    return re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)


def options_of(config: Config) -> C.Options:
    return C.Options(target=PROFILES.get(config.target, TargetProfile()), columns=config.columns, sections=config.sections)


def corpus_scan(spark: SparkSession, source: str, output: str, config: Config = Config()) -> dict[str, DataFrame]:
    """The first of two phases: what the pages below source have in common, saved below output and read back, with an encoding report."""
    decoded = D.decode_pages(S.html_files(spark, source).withColumn("page", F.sha2("content", 256)))
    profile = P.scan(decoded.dropDuplicates(["page"]), "page", "text", config.chrome_threshold)
    S.save_profile({**profile, "encodings": P.encoding_report(decoded, ["name"])}, output)
    return S.load_profile(spark, output)


def corpus_run(spark: SparkSession, source: str, output: str, config: Config = Config(), profile: str | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """The second: convert what no finished run has done; returns (path, name, state, ...) of the pages converted now.

    A page is known by its path, the hash of its bytes, the engine and the profile.  Equal files are converted once, and have a row each; a
    file that a finished run has met under another path takes that row.  Finished pages are a table below output, which is
    appended to in one commit.  profile: a folder that corpus_scan wrote.  decisions: (key, value, confidence) for tables that
    the rules leave undecided, keyed as escalations() does; what isn't decided there stays as it is.
    """
    known = S.load_profile(spark, profile) if profile else None
    name = config.profile if profile is None else f"{config.profile}:{os.path.basename(profile.rstrip('/'))}"
    jobs = B.job_identity(S.html_files(spark, source), "content", ENGINE, name)
    done, keys = f"{output}/runs", ["source_sha256", "engine_version", "profile_id"]
    path = spark._jvm.org.apache.hadoop.fs.Path(done)
    finished = None
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        finished = spark.read.parquet(done)
        jobs = jobs.join(finished.select("path", *keys), ["path", *keys], "left_anti")
    unique = jobs.select(*keys, "content").dropDuplicates(keys)
    if finished is not None:
        unique = unique.join(finished.select(*keys).distinct(), keys, "left_anti")
    decoded = D.decode_pages(unique)
    made = P.convert_pages(decoded, "source_sha256", "text", known, options_of(config), config.min_recall, config.max_line)
    if decisions is not None:
        made = resolved(decoded, made, decisions, known, config)
    made = decoded.select("source_sha256", "codec").join(made, "source_sha256")
    if finished is not None:
        before = finished.join(jobs.select(*keys).distinct(), keys, "left_semi").dropDuplicates(keys)
        made = made.unionByName(before.select(made.columns))
    run_id = uuid.uuid4().hex
    jobs.drop("content").join(made, "source_sha256").withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(done)
    return spark.read.parquet(done).where(F.col("run_id") == run_id)


def escalations(made: DataFrame, id_col: str = "source_sha256") -> DataFrame:
    """(id, seq, key): the tables that the rules leave undecided; key names the question, so that an answer is found again."""
    asked = made.select(id_col, F.explode("tables").alias("t")).where("t.class = 'UNKNOWN'")
    return asked.select(id_col, F.col("t.seq").alias("seq"), F.concat_ws(":", F.col(id_col), F.col("t.seq"), F.lit(ENGINE)).alias("key"))


def resolved(decoded: DataFrame, made: DataFrame, decisions: DataFrame, known: dict[str, DataFrame] | None, config: Config) -> DataFrame:
    """made, with the pages converted again whose undecided tables have an answer within the budget of the run."""
    asked = escalations(made).withColumn("deterministic", F.lit(None).cast("string"))
    answered = B.decide(asked, decisions).where("source = 'cache'").select("source_sha256", F.struct("seq", F.col("decision").alias("class")).alias("x"))
    answers = answered.groupBy("source_sha256").agg(F.sort_array(F.collect_list("x")).alias("classes"))
    again = P.convert_pages(decoded.join(answers, "source_sha256"), "source_sha256", "text", known, options_of(config), config.min_recall, config.max_line, classes="classes")
    return made.join(answers, "source_sha256", "left_anti").unionByName(again)


def summary(done: DataFrame) -> DataFrame:
    """(run_id, documents, complete, structurally_valid, review_required, mean_recall): how each run ended."""
    n = lambda s: F.sum((F.col("state") == s).cast("int")).alias(s.replace("-", "_"))
    return done.groupBy("run_id").agg(F.count("*").alias("documents"), n("complete"), n("structurally-valid"), n("review-required"), F.avg("recall").alias("mean_recall"))
