"""Typography, lines, media, geometry and outline: expressions and windows over small relations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.compile import levels
from quire.functions.text import col

LEGACY_PX = {"1": 10, "2": 13, "3": 16, "4": 18, "5": 24, "6": 32, "7": 48}

# -- typography


def css_px(c: Column | str) -> Column:
    """A CSS length in pixels; null where it is none."""
    v = F.lower(F.trim(col(c)))
    number = F.regexp_extract(v, r"^(-?[0-9]*\.?[0-9]+)\s*(px|pt|em|rem|%)?$", 1).try_cast("double")
    unit = F.regexp_extract(v, r"^(-?[0-9]*\.?[0-9]+)\s*(px|pt|em|rem|%)?$", 2)
    return F.when(unit == "pt", number * 4 / 3).when(unit.isin("em", "rem"), number * 16).when(unit == "%", number / 100 * 16).otherwise(number)


def legacy_px(c: Column | str) -> Column:
    """Pixels of a font size of 1 to 7, or relative to 3."""
    v = F.trim(col(c))
    n = v.try_cast("int")
    size = F.greatest(F.lit(1), F.least(F.lit(7), F.when(v.rlike(r"^[+-]"), 3 + n).otherwise(n)))
    table = F.create_map(*[F.lit(x) for k, p in LEGACY_PX.items() for x in (int(k), p)])
    return F.when(n.isNotNull(), F.try_element_at(table, size))


def prominence(px: Column, bold: Column, centered: Column, text: Column) -> Column:
    caps = (F.length(text) <= 60) & text.rlike(r"\p{L}") & (F.upper(text) == text)
    return px / 16 * F.when(bold, 1.15).otherwise(1.0) * F.when(centered, 1.05).otherwise(1.0) * F.when(caps, 1.1).otherwise(1.0)


def upper_median(values: Column) -> Column:
    """The element at floor(n / 2) of the sorted values: an element, not a mean of two."""
    s = F.sort_array(values)
    return F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def body_baseline(blocks: DataFrame, key: str, score: str = "score", text_len: str = "text_len", least: int = 200) -> DataFrame:
    """(key, baseline): the upper median of long blocks' scores, 1 where there are none."""
    per = blocks.groupBy(key).agg(upper_median(F.collect_list(F.when(F.col(text_len) >= least, F.col(score)))).alias("baseline"))
    return per.fillna(1.0, ["baseline"])


def headings(blocks: DataFrame, key: str) -> DataFrame:
    """(key, ord, depth): blocks (ord, text, score, text_len) that stand out from the body: one title, then sections.

    Title: the most prominent candidate of at most 120 characters, at least 1.25 times the baseline, the first of equals.
    Sections: at least 1.12 times, less than 0.98 of the title, at most 70 characters.
    """
    label = F.col("text").rlike(r"\p{L}") & ~F.col("text").rlike(r"[,;:]\s*$") & (F.size(F.split(F.trim("text"), r"\s+")) <= 10)
    base = body_baseline(blocks, key)
    c = blocks.join(base, key).where(label & (F.col("text_len") <= 120)).withColumn("rel", F.col("score") / F.col("baseline"))
    c = c.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("rel"), "ord"))).withColumn("top", F.max("rel").over(Window.partitionBy(key)))
    title = (F.col("k") == 1) & (F.col("rel") >= 1.25)
    section = (F.col("k") > 1) & (F.col("rel") >= 1.12) & ((F.col("rel") < 0.98 * F.col("top")) | (F.col("top") < 1.25)) & (F.col("text_len") <= 70)
    return c.select(key, "ord", F.when(title, 1).when(section, 2).alias("depth")).where("depth IS NOT NULL")


def stacked_templates(labels: DataFrame, key: str) -> DataFrame:
    """(key, run, n): runs of two labels and more with one signature and nothing between (start, end, signature, ord)."""
    w = Window.partitionBy(key).orderBy("ord")
    opens = F.coalesce(((F.lag("signature").over(w) != F.col("signature")) | (F.lag("end").over(w) != F.col("start"))).cast("int"), F.lit(1))
    runs = labels.withColumn("o", opens).withColumn("run", F.sum("o").over(w))
    return runs.groupBy(key, "run").agg(F.count("*").alias("n")).where("n >= 2")


def text_offsets(blocks: DataFrame, key: str) -> DataFrame:
    """Visible characters before each block (ord, text_len)."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum("text_len").over(w), F.lit(0)))


def enforce_single_title(heads: DataFrame, key: str) -> DataFrame:
    """heads (ord, depth) with ``level``: a scan with state over the headings of each document."""
    rows = heads.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "depth"))).alias("h"))
    lift = F.udf(lambda depths: levels(list(depths)), "array<int>", useArrow=True)
    zipped = rows.select(key, F.arrays_zip(F.col("h.ord").alias("ord"), F.col("h.depth").alias("depth"), lift(F.col("h.depth")).alias("level")).alias("z"))
    return zipped.select(key, F.inline("z").alias("ord", "depth", "level"))


# -- alignment


def fold_text_align(c: Column | str) -> Column:
    v = F.regexp_replace(F.lower(F.trim(col(c))), r"^-(?:moz|webkit|khtml|ms)-", "")
    return F.when(v.isin("center", "centre", "middle"), "center").when(v.isin("right", "end"), "right").when(v.isin("left", "start"), "left").when(v == "justify", "justify")


def prose_alignment(blocks: DataFrame, key: str, least: int = 120, samples: int = 2) -> DataFrame:
    """(key, align): the alignment of most text in long blocks (align, text_len), ties in the order left, justify, center, right."""
    order = F.create_map(F.lit("left"), F.lit(0), F.lit("justify"), F.lit(1), F.lit("center"), F.lit(2), F.lit("right"), F.lit(3))
    long = blocks.where((F.col("text_len") >= least) & F.col("align").isNotNull())
    per = long.groupBy(key, "align").agg(F.sum("text_len").alias("w"), F.count("*").alias("n"))
    per = per.withColumn("all", F.sum("n").over(Window.partitionBy(key))).where(F.col("all") >= samples)
    first = Window.partitionBy(key).orderBy(F.desc("w"), order[F.col("align")])
    return per.withColumn("k", F.row_number().over(first)).where("k = 1").select(key, "align")


def distinctive_align(align: Column, baseline: Column) -> Column:
    same = lambda c: F.when(c == "justify", "left").otherwise(c)
    return F.when(align.isNull(), F.lit(False)).when(baseline.isNull(), align.isin("center", "right")).otherwise(same(align) != same(baseline))


def box_alignment(x: Column, w: Column, cx: Column, cw: Column, tolerance: float = 4) -> Column:
    """Alignment that a box shows inside its container; null where it fills it."""
    left, right = x - cx, cx + cw - x - w
    return F.when((F.abs(left) <= tolerance) & (F.abs(right) <= tolerance), F.lit(None)).when(F.abs(left - right) <= tolerance, "center").when(F.abs(right) <= tolerance, "right").otherwise("left")


def overflow(x: Column, w: Column, cx: Column, cw: Column, tolerance: float = 1) -> Column:
    """Pixels outside the container; what is within the tolerance of rounding is none."""
    out = F.greatest(F.lit(0.0), cx - x, x + w - cx - cw)
    return F.when(out > tolerance, out).otherwise(F.lit(0.0))


# -- geometry


def bands_of(boxes: list[tuple[float, float, float]]) -> list[int]:
    """Band of each (y, h, x), in the order of y and x: a box joins while it overlaps the band's first box by more than half of the shorter."""
    out, anchor, band = [], None, -1
    for y, h, _ in boxes:
        if anchor is not None and min(y + h, anchor[0] + anchor[1]) - max(y, anchor[0]) > 0.5 * min(h, anchor[1]):
            out.append(band)
            continue
        anchor, band = (y, h), band + 1
        out.append(band)
    return out


def row_bands(boxes: DataFrame, key: str) -> DataFrame:
    """(key, id, band, rank) of boxes (id, x, y, w, h): the band's anchor isn't the previous row, so a group is scanned in one go."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("y", "ascending"), ("x", "ascending"), ("id", "ascending")])
        band = bands_of(list(zip(rows["y"].to_pylist(), rows["h"].to_pylist(), rows["x"].to_pylist())))
        xs, ys = rows["x"].to_pylist(), rows["y"].to_pylist()
        order = sorted(range(len(band)), key=lambda i: (band[i], xs[i], ys[i], i))
        rank = [0] * len(band)
        for r, i in enumerate(order):
            rank[i] = r
        return pa.table({key: rows[key], "id": rows["id"], "band": pa.array(band, pa.int32()), "rank": pa.array(rank, pa.int32())})

    kind = dict(boxes.dtypes)
    return boxes.select(key, "id", "x", "y", "w", "h").groupBy(key).applyInArrow(run, f"{key} {kind[key]}, id {kind['id']}, band int, rank int")


def reading_ranks(boxes: DataFrame, key: str) -> DataFrame:
    """Rank of each box by (band, x, y, id) where bands are known."""
    return boxes.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("band", "x", "y", "id")) - 1)


def lanes(boxes: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """(key, id, lane): boxes (id, x, w) dealt to lanes from the left: one joins while it overlaps the lane's first box by more than half of the narrower."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("x", "ascending"), ("id", "ascending")])
        out, first, lane = [], None, -1
        for x, w in zip(rows["x"].to_pylist(), rows["w"].to_pylist()):
            if first is None or min(x + w, first[0] + first[1]) - max(x, first[0]) <= least * min(w, first[1]):
                first, lane = (x, w), lane + 1
            out.append(lane)
        return pa.table({key: rows[key], "id": rows["id"], "lane": pa.array(out, pa.int32())})

    kind = dict(boxes.dtypes)
    return boxes.select(key, "id", "x", "w").groupBy(key).applyInArrow(run, f"{key} {kind[key]}, id {kind['id']}, lane int")


def compare_layouts(produced: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """(key, block, class, produced, reference): where two rendered documents differ, over boxes (key, block, x, y, w, h, cx, cw, text_align) of the blocks that both have.

    layout.align.mismatch: another alignment, declared or else shown by the box; layout.order.mismatch: another place in the reading
    order of those blocks; layout.containment.mismatch: outside the container in one of the two only.
    """
    both = produced.select(key, "block").join(reference.select(key, "block"), [key, "block"], "left_semi").distinct()

    def side(df: DataFrame, name: str) -> DataFrame:
        box = (F.col("x"), F.col("w"), F.col("cx"), F.col("cw"))
        own = df.join(both, [key, "block"], "left_semi").withColumn("id", F.col("block"))
        rank = row_bands(own, key).select(key, F.col("id").alias("block"), "rank")
        shown = own.select(key, "block", F.coalesce(fold_text_align("text_align"), box_alignment(*box), F.lit("left")).alias("align"), (overflow(*box) > 0).alias("out"))
        return shown.join(rank, [key, "block"]).select(key, "block", F.struct("align", "rank", "out").alias(name))

    pairs = side(produced, "p").join(side(reference, "r"), [key, "block"])
    flat = lambda c: F.when(c == "justify", "left").otherwise(c)
    kinds = [("align", flat(F.col("p.align")) != flat(F.col("r.align"))), ("order", F.col("p.rank") != F.col("r.rank")), ("containment", F.col("p.out") != F.col("r.out"))]
    value = {"align": "align", "order": "rank", "containment": "out"}
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(f"layout.{k}.mismatch").alias("class"), F.col(f"p.{value[k]}").cast("string").alias("produced"), F.col(f"r.{value[k]}").cast("string").alias("reference"))) for k, test in kinds]))
    return pairs.select(key, "block", F.inline(found))


# -- lines


def is_wrap_break(line: Column, following: Column, indent: Column, next_indent: Column) -> Column:
    """Whether the break after a line is a wrap, not an end."""
    ends = line.rlike(r"[.!?…:;»”\")]\s*$")
    goes_on = line.rlike(r"[,–—-]\s*$") | following.rlike(r"^\s*\p{Ll}")
    return F.coalesce(~ends & goes_on & ((indent == 0) | (indent != next_indent)), F.lit(False))


def line_groups(lines: DataFrame, key: str) -> DataFrame:
    """lines (ord, gap) with ``grp``: a gap of two breaks and more begins a group."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("grp", F.sum((F.col("gap") >= 2).cast("int")).over(w))


def enumerated_groups(lines: DataFrame, key: str) -> DataFrame:
    """(key, grp, n): groups of three lines and more that begin with strictly rising ordinals of one to three digits; dates aren't ordinals."""
    ordinal = F.when(~F.col("text").rlike(r"^\s*\d{1,2}\.\d{1,2}\.\d{2,4}"), F.regexp_extract("text", r"^\s*(\d{1,3})[.)]\s", 1)).try_cast("int")
    n = lines.withColumn("o", ordinal).withColumn("p", F.lag("o").over(Window.partitionBy(key, "grp").orderBy("ord")))
    per = n.groupBy(key, "grp").agg(F.count("*").alias("n"), F.min(F.col("o").isNotNull()).alias("all"), F.min(F.coalesce(F.col("o") > F.col("p"), F.col("p").isNull())).alias("rising"))
    return per.where("n >= 3 AND all AND rising").select(key, "grp", "n")


def leader_rows(lines: DataFrame, key: str) -> DataFrame:
    """(key, ord, label, value): lines split at the first run of four dots and more, where a text has three such lines."""
    m = lines.where(F.col("text").rlike(r"\.{4,}"))
    n = F.count("*").over(Window.partitionBy(key))
    return m.withColumn("n", n).where("n >= 3").select(key, "ord", F.trim(F.regexp_extract("text", r"^(.*?)\.{4,}", 1)).alias("label"), F.trim(F.regexp_extract("text", r"^.*?\.{4,}(.*)$", 1)).alias("value"))


def drawn_rule(c: Column | str) -> Column:
    """Whether a text is nothing but three and more of one ornament."""
    return F.regexp_replace(col(c), r"\s", "").rlike(r"^([*•·=~_—–-])\1{2,}$")


def bulleted_runs(blocks: DataFrame, key: str) -> DataFrame:
    """(key, run, mark, n): two paragraphs and more in a row that open with the same mark (ord, text)."""
    mark = F.nullif(F.regexp_extract("text", r"^\s*([•·▪◦●■–—*-])\s+", 1), F.lit(""))
    w = Window.partitionBy(key).orderBy("ord")
    m = blocks.withColumn("mark", mark).withColumn("o", F.coalesce((~F.col("mark").eqNullSafe(F.lag("mark").over(w))).cast("int"), F.lit(1)))
    runs = m.withColumn("run", F.sum("o").over(w)).where("mark IS NOT NULL")
    return runs.groupBy(key, "run", "mark").agg(F.count("*").alias("n")).where("n >= 2")


def date_label(c: Column | str) -> Column:
    return F.trim(col(c)).rlike(r"(?i)^(?:\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{1,2}\s+\p{L}+\s+\d{4}(?:\s*г\.?)?)$")


# -- media


def content_width(blocks: DataFrame, key: str, least: int = 200) -> DataFrame:
    """(key, width): the element at floor(n / 4) of the sorted widths of long blocks (w, text_len)."""
    s = F.sort_array(F.collect_list(F.when(F.col("text_len") >= least, F.col("w"))))
    return blocks.groupBy(key).agg(s.alias("s")).select(key, F.try_element_at("s", (F.floor(F.size("s") * 0.25) + 1).cast("int")).alias("width"))


def size_token(width: Column, content: Column) -> Column:
    share = width / content
    return (
        F.when(width.isNull(), "medium")
        .when(content.isNotNull() & (content > 0), F.when(share >= 0.92, "large").when(share >= 0.55, "medium").otherwise("small"))
        .when(width >= 380, "large").when(width >= 190, "medium").otherwise("small")
    )


def is_decorative(src: Column, width: Column, height: Column, alt: Column) -> Column:
    strip = (width / height >= 6) | (height / width >= 6)
    furniture = F.lower(F.regexp_extract(src, r"([^/]*)$", 1)).rlike(r"^(?:spacer|blank|pixel|line|bullet|dot|bg|back|arrow|top|up|home)\d*\.(?:gif|png|jpe?g)$")
    return src.isNull() | (F.trim(src) == "") | F.coalesce((width * height <= 196) | (F.least(width, height) <= 3) | (strip & (F.coalesce(alt, F.lit("")) == "")), F.lit(False)) | F.coalesce(furniture, F.lit(False))


def caption_from_alt(alt: Column) -> Column:
    a = F.trim(alt)
    bad = (a == "") | a.rlike(r"(?i)\.(?:bmp|gif|jpg|jpeg|png)$") | a.rlike(r"(?i)^(?:image|photo|picture|img|фото|рисунок)?\s*\d*$") | (F.length(a) > 300)
    return F.when(~bad, a)


def image_rows(images: DataFrame, key: str, max_ratio: float = 2.5) -> DataFrame:
    """(key, n, columns): groups of two images and more whose heights differ by at most max_ratio; 2, 3 or 4 columns."""
    per = images.groupBy(key).agg(F.count("*").alias("n"), (F.max("h") / F.min("h")).alias("r")).where((F.col("n") >= 2) & (F.col("r") <= max_ratio))
    return per.select(key, "n", F.when(F.col("n") % 3 == 0, 3).when(F.col("n") % 4 == 0, 4).when(F.col("n") <= 4, F.col("n").cast("int")).otherwise(3).alias("columns"))


def palette(color: Column | str) -> Column:
    """black, white, red or gold: the nearest of four for a named, hexadecimal or rgb() colour; null if it is none."""
    c = F.lower(F.trim(col(color)))
    named = F.create_map(*[F.lit(x) for k, v in {"black": "000000", "white": "ffffff", "red": "ff0000", "gold": "ffd700", "yellow": "ffff00", "maroon": "800000", "navy": "000080", "silver": "c0c0c0", "gray": "808080"}.items() for x in (k, v)])
    short = F.regexp_replace(F.regexp_extract(c, r"^#([0-9a-f]{3})$", 1), r"([0-9a-f])", "$1$1")
    rgb = [F.regexp_extract(c, r"^rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)$", i).try_cast("int") for i in (1, 2, 3)]
    digits = F.coalesce(F.try_element_at(named, c), F.nullif(F.regexp_extract(c, r"^#?([0-9a-f]{6})$", 1), F.lit("")), F.nullif(short, F.lit("")), F.when(rgb[0].isNotNull(), F.format_string("%02x%02x%02x", *rgb)))
    r, g, b = (F.conv(F.substring(digits, i, 2), 16, 10).cast("int") for i in (1, 3, 5))
    return F.when(digits.isNull(), F.lit(None)).when((r > 150) & (g > 110) & (b < 120), "gold").when((r > 120) & (g < 90) & (b < 90), "red").when(r + g + b >= 560, "white").otherwise("black")


LAYOUT_ICONS = {"mp3": "♪", "note": "♪", "mail": "✉", "email": "✉", "home": "⌂", "up": "↑", "top": "↑", "next": "→", "prev": "←", "back": "←", "print": "⎙", "disk": "💾", "zip": "🗜", "pdf": "📄", "video": "▶", "play": "▶", "star": "★"}


def icon_glyph(src: Column | str) -> Column:
    """The sign for a well-known icon file, digits after its name or not; else null."""
    stem = F.regexp_extract(F.lower(col(src)), r"([^/]*)\.[a-z]+$", 1)
    signs = F.create_map(*[F.lit(x) for kv in LAYOUT_ICONS.items() for x in kv])
    return F.coalesce(F.try_element_at(signs, stem), F.try_element_at(signs, F.regexp_replace(stem, r"\d+$", "")))
