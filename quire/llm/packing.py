"""Vector bin packing of training examples (operator 4).

An example is a vector: tokens, segments, loss-bearing tokens.  A bin (one training sequence) is limited in
all three.  Examples are dealt to shards of about SHARD examples by a hash of their id; a shard is packed by the
dot-product heuristic: into the open bin goes, of all examples that fit, the one whose vector has the greatest
weighted dot product with what is left of the bin; when none fits, the next bin opens.  A shard is one group of a
grouped-map, so the work is linear in the input and a bin never spans shards.  Rows without an id, and those of an id that
has more rows than half a shard, are dealt by their place in the written table instead, as they'd all fall into one shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm import shared

MAX_TOKENS = 4096
MAX_SEGMENTS = 32
MAX_LOSS = 3072
SHARD = 2048


def pack_vectors(vectors: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin of each vector (n x 3, in the order in which ties are broken); every vector must fit an empty bin."""
    n = len(vectors)
    bins = np.full(n, -1, np.int64)
    if not n:
        return bins
    share = vectors / limits
    weight = share.mean(axis=0)  # scarce resources count more
    weight = weight / max(weight.sum(), 1e-12)
    # equal vectors are one kind with a count, so that a step costs as much as there are kinds
    kinds, kind = np.unique(vectors, axis=0, return_inverse=True)
    kind = kind.ravel()
    members = np.argsort(kind, kind="stable")
    at = np.searchsorted(kind[members], np.arange(len(kinds)))
    end = np.append(at[1:], n)
    scaled = kinds / limits * weight
    current, left, todo = 0, limits.astype(np.float64).copy(), n
    while todo:
        fits = (kinds <= left).all(axis=1)
        if not fits.any():
            current, left = current + 1, limits.astype(np.float64).copy()
            continue
        score = np.where(fits, scaled @ (left / limits), -1.0)
        best = int(score.argmax())
        while at[best] < end[best] and (kinds[best] <= left).all():  # the same kind stays best only once: recheck
            bins[members[at[best]]] = current
            left -= kinds[best]
            at[best] += 1
            todo -= 1
            break
        if at[best] == end[best]:
            live = at < end
            kinds, scaled, at, end = kinds[live], scaled[live], at[live], end[live]
    return bins


def pieces(examples: DataFrame, id_col: str, max_tokens: int, max_segments: int, max_loss: int) -> DataFrame:
    """(id, piece, tokens, segments, loss): an example that breaks a limit by itself, cut into equal pieces that don't.

    Each piece of an example that has segments takes one at least, as it is one in its bin.
    """
    need = F.greatest(F.lit(1), F.ceil(F.col("tokens") / max_tokens), F.ceil(F.col("segments") / max_segments), F.ceil(F.col("loss") / max_loss)).cast("int")
    share = lambda c: (F.floor(F.col(c) * (F.col("piece") + 1) / F.col("n_pieces")) - F.floor(F.col(c) * F.col("piece") / F.col("n_pieces"))).cast("bigint")
    segments = F.when((F.col("n_pieces") > 1) & (F.col("segments") > 0), F.greatest(F.lit(1).cast("bigint"), share("segments"))).otherwise(share("segments"))
    cut = examples.withColumn("n_pieces", need).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    return cut.select(F.col(id_col), "piece", share("tokens").alias("tokens"), segments.alias("segments"), share("loss").alias("loss"))


def cut_turns(turns: list[tuple[int, int]], limits: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """(tokens, segments, loss) of the pieces of an example whose turns are (tokens, loss).

    A piece takes whole turns in their order while no limit breaks; only a turn that breaks one alone is cut,
    evenly, as its loss lies all over it.
    """
    made, now = [], (0, 0, 0)
    for tokens, loss in turns:
        n = max(1, -(-tokens // limits[0]), -(-loss // limits[2]))
        for i in range(n):
            part = (tokens * (i + 1) // n - tokens * i // n, 1, loss * (i + 1) // n - loss * i // n)
            then = tuple(a + b for a, b in zip(now, part))
            if now[1] and any(a > b for a, b in zip(then, limits)):
                made.append(now)
                then = part
            now = then
    return [*made, now]


def turn_pieces(examples: DataFrame, id_col: str, max_tokens: int, max_segments: int, max_loss: int) -> DataFrame:
    """pieces() of examples (id, turns: array of (tokens, loss)), cut between turns."""
    kind, limits = dict(examples.dtypes)[id_col], (max_tokens, max_segments, max_loss)
    total = lambda field: F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, x: a + x[field])
    given = examples.select(F.col(id_col), "turns", total("tokens").alias("tokens"), F.size("turns").cast("bigint").alias("segments"), total("loss").alias("loss"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.stack([batch.column(i).to_numpy() for i in (2, 3, 4)], axis=1)
            fits = (sizes <= limits).all(axis=1)
            over = np.flatnonzero(~fits)
            cuts = [cut_turns([(t["tokens"], t["loss"]) for t in turns], limits) for turns in batch.column(1).take(pa.array(over)).to_pylist()]
            row = np.concatenate([np.flatnonzero(fits), np.repeat(over, [len(c) for c in cuts])]).astype(np.int64)
            piece = np.array([0] * int(fits.sum()) + [i for c in cuts for i in range(len(c))], np.int32)
            made = np.concatenate([sizes[fits], *[np.array(c, np.int64) for c in cuts]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece), *(pa.array(np.ascontiguousarray(made[:, i])) for i in range(3))], [id_col, "piece", "tokens", "segments", "loss"])

    return given.mapInArrow(cut, f"`{id_col}` {kind}, piece int, tokens bigint, segments bigint, loss bigint")


def pack(
    examples: DataFrame,
    id_col: str,
    tokens_col: str | None = None,
    segments_col: str | None = None,
    loss_col: str | None = None,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_LOSS,
    shard: int = SHARD,
    turns_col: str | None = None,
) -> DataFrame:
    """(shard, bin, id, piece, tokens, segments, loss): where each example, or piece of one, is placed.

    Bins are numbered within a shard.  Without segments_col an example is one segment, without loss_col all its
    tokens bear loss.  Null or negative sizes count as 0; an example without tokens still takes its segments.
    An example that exceeds a limit alone is cut into the least number of equal pieces that don't: nothing is
    dropped, and each piece is one segment at least.  With turns_col, an array of structs (tokens, loss) in the
    order of the turns, the other columns aren't read: every turn is a segment, and an example over a limit is
    cut between its turns, so that a piece holds the loss of its own turns.  Null ids are packed like others, repeated rows each on their own;
    however many rows share an id or have none, shards stay of about the same size.  An empty table gives an empty result.  Ties go to the least vector, then the least id and piece.
    """
    size = lambda c: F.greatest(F.coalesce(F.col(c).cast("bigint"), F.lit(0)), F.lit(0))
    if turns_col:
        at_least_0 = lambda x: F.greatest(F.coalesce(x.cast("bigint"), F.lit(0)), F.lit(0))
        turns = F.transform(F.coalesce(F.col(turns_col), F.array()), lambda x: F.struct(at_least_0(x["tokens"]).alias("tokens"), at_least_0(x["loss"]).alias("loss")))
        cut = turn_pieces(examples.select(F.col(id_col), turns.alias("turns")), id_col, max_tokens, max_segments, max_loss)
    else:
        given = examples.select(
            F.col(id_col),
            size(tokens_col).alias("tokens"),
            (size(segments_col) if segments_col else F.lit(1).cast("bigint")).alias("segments"),
            (size(loss_col) if loss_col else size(tokens_col)).alias("loss"),
        )
        cut = pieces(given, id_col, max_tokens, max_segments, max_loss)
    given = shared.written(cut, "pieces")
    shards = max(1, math.ceil(given.count() / shard))
    kind, limits = dict(given.dtypes)[id_col], np.array([max_tokens, max_segments, max_loss])
    key, place_of = F.xxhash64(id_col, "piece"), F.xxhash64(F.monotonically_increasing_id())
    many = shared.written(given.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where(F.col("count") > shard // 2).select(id_col), "many")
    if many.isEmpty():
        key = F.when(F.col(id_col).isNull(), place_of).otherwise(key)
    else:
        given = given.withColumn("at", place_of).join(many.withColumn("many", F.lit(True)), id_col, "left")
        key = F.when(F.col(id_col).isNull() | F.col("many"), F.col("at")).otherwise(key)
    dealt = given.withColumn("shard", F.pmod(key, F.lit(shards)).cast("bigint"))

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(id_col, "ascending"), ("piece", "ascending"), ("tokens", "ascending"), ("segments", "ascending"), ("loss", "ascending")])
        vectors = np.stack([rows[c].to_numpy() for c in ("tokens", "segments", "loss")], axis=1)
        return rows.append_column("bin", pa.array(pack_vectors(vectors, limits))).select(names)

    names = ["shard", "bin", id_col, "piece", "tokens", "segments", "loss"]
    return dealt.groupBy("shard").applyInArrow(place, f"shard bigint, bin bigint, `{id_col}` {kind}, piece int, tokens bigint, segments bigint, loss bigint")
