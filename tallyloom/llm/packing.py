"""Documents into containers of fixed capacity with little space left over, by the sum-of-squares rule.

Every packer keeps an array with the number of containers at each fill level.
A document goes where the sum of the squared counts of partly filled
containers becomes least: on the level, or into a new container, that changes
it most favourably. Containers that came out full are done. What the partly filled containers of
all packers hold is dealt anew to fewer packers and placed by the same rule, round after round, so that the space left over doesn't grow with the packers.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.storage import materialize

#: Documents that one packer places; bounds its memory and time, whatever the number of documents.
PER_PACKER = 20_000
#: Rounds of placement; each takes on what the one before left in partly filled containers.
ROUNDS = 5
#: Fixed value: the public pattern by which byte-level BPE splits text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(df: DataFrame, doc_id: Column, text: Column, ranks_file: str) -> DataFrame:
    """doc_id, tokens: the length of every text under the byte-level BPE whose ranks are in ``ranks_file``; null and empty texts have 0. Documents without id are left out."""
    with open(ranks_file, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in held.value.splitlines() if line)}
        encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in batch["t"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": np.array(n, np.int64)})

    rows = df.select(doc_id.cast("long").alias("doc_id"), text.alias("t")).where(F.col("doc_id").isNotNull())
    return rows.mapInPandas(run, "doc_id long, tokens long")


def sum_of_squares(sizes: Sequence[int], capacity: int) -> np.ndarray:
    """The container of each size (from 0, in order of opening), for sizes from 1 to capacity."""
    count = np.zeros(capacity + 1, np.int64)  # containers at each level, partly filled ones only
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.zeros(len(sizes), np.int64)
    n = 0
    for i, s in enumerate(sizes):
        s = int(s)
        best, level = (2 * count[s] + 1 if s < capacity else 0), 0
        levels = np.flatnonzero(count[: capacity - s + 1])
        if len(levels):
            after = count[levels + s]
            change = 2 * (after - count[levels]) + 2
            change[levels + s == capacity] -= 1  # a full container counts no more
            k = len(levels) - 1 - int(change[::-1].argmin())  # of equal ones the fullest
            if change[k] <= best:
                level = int(levels[k])
        if level:
            c = open_at[level].pop()
            count[level] -= 1
        else:
            c = n
            n += 1
        out[i] = c
        if level + s < capacity:
            count[level + s] += 1
            open_at[level + s].append(c)
    return out


def tightest_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each size, largest first, each into the least space that holds it."""
    out = np.zeros(len(sizes), np.int64)
    space: list[tuple[int, int]] = []
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        k = bisect_left(space, (s, -1))
        if k < len(space):
            left, c = space.pop(k)
        else:
            left, c = capacity, n
            n += 1
        out[i] = c
        if left > s:
            insort(space, (left - s, c))
    return out


def pack_documents(sizes: DataFrame, targets: DataFrame, per_packer: int = PER_PACKER, rounds: int = ROUNDS, tighten: bool = False) -> DataFrame:
    """Pieces and their containers: target_id, container, doc_id, part, first_token, tokens.

    ``sizes`` has doc_id and tokens (at least 0; documents of 0 tokens or null take no place), ``targets`` target_id and capacity_tokens (a small
    table; repeated rows are packed each; null or non-positive capacities are passed over). Only a document
    longer than a capacity is divided: into full containers of its own and one
    rest, which is packed like a whole document. Documents are dealt to
    packers by hash, so that none has more than about ``per_packer`` of
    them; containers are named ``target-round-packer-number``, those of full parts ``target-doc-part-place in the list``.
    After each round but the last the pieces of partly filled containers go on to the next. With
    ``tighten`` the last round packs largest first into the tightest space instead of by the sum of squares.
    """
    if rounds < 1:
        raise ValueError("at least one round")
    wanted = [(int(r[0]), int(r[1])) for r in targets.select("target_id", "capacity_tokens").where("capacity_tokens > 0").collect()]
    sizes = sizes.where((F.col("tokens") > 0) & F.col("doc_id").isNotNull()).select("doc_id", F.col("tokens").cast("long").alias("tokens"))
    if not wanted:
        wanted = [(-1, 1)]
        sizes = sizes.limit(0)
    # a target that is listed twice is packed twice
    each = sizes.select("doc_id", "tokens", F.inline(F.array(*[F.struct(F.lit(i).alias("target"), F.lit(t).alias("target_id"), F.lit(c).alias("capacity")) for i, (t, c) in enumerate(wanted)])))
    each = each.withColumn("whole", F.floor(F.col("tokens") / F.col("capacity")).cast("int"))
    full = each.where("whole > 0").select("target", "target_id", "doc_id", "capacity", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("part"))
    done = full.select(
        "target_id", F.concat_ws("-", "target_id", F.concat(F.lit("d"), F.col("doc_id")), "part", "target").alias("container"),
        "doc_id", "part", (F.col("part").cast("long") * F.col("capacity")).alias("first_token"), F.col("capacity").cast("long").alias("tokens"),
    )
    rest = each.select("target", "target_id", "capacity", "doc_id", F.col("whole").alias("part"), (F.col("tokens") - F.col("whole").cast("long") * F.col("capacity")).alias("tokens")).where("tokens > 0")
    rest = materialize(rest, "pieces")
    schema = "target int, target_id int, capacity int, doc_id long, part int, tokens long, container string, loose boolean"
    for r in range(rounds):
        last = r == rounds - 1
        n = {x.target: x.n for x in rest.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a target
        if not n:
            break
        packers = F.create_map(*[x for t, k in n.items() for x in (F.lit(t), F.lit(math.ceil(k / per_packer)))])
        dealt = rest.withColumn("packer", F.pmod(F.xxhash64("doc_id", "part", F.lit(r)), packers[F.col("target")]).cast("int"))
        rest = materialize(dealt.groupBy("target", "packer").applyInPandas(_placer(r, tighten and last), schema), "packed")
        final = rest if last else rest.where(~F.col("loose"))
        done = done.unionByName(final.select("target_id", "container", "doc_id", "part", (F.col("part").cast("long") * F.col("capacity")).alias("first_token"), "tokens"))
        rest = rest.where("loose").drop("container", "loose")
    return done


def _placer(r: int, tighten: bool):
    """Packs one packer's pieces in an order that doesn't follow their ids."""

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part", "tokens"], ignore_index=True)
        pdf = pdf.iloc[np.random.default_rng(11 + r).permutation(len(pdf))]
        first = pdf.iloc[0]
        capacity, tokens = int(first["capacity"]), pdf["tokens"].to_numpy()
        at = tightest_fit(tokens, capacity) if tighten else sum_of_squares(tokens, capacity)
        name = f"{first['target_id']}-{r}-{first['target']}.{first['packer']}-"
        return pdf.drop(columns="packer").assign(container=[name + str(c) for c in at], loose=np.bincount(at, tokens)[at] < capacity)

    return place


def check_packing(pieces: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """What must hold of a packing, per target: target_id, capacity_tokens, n_documents, over_capacity (containers too full), wrong_documents (not each token once, in one part unless larger than the capacity)."""
    t = targets.select("target_id", "capacity_tokens")
    over = pieces.groupBy("target_id", "container").agg(F.sum("tokens").alias("n")).join(F.broadcast(t), "target_id").groupBy("target_id").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("over_capacity"))
    docs = pieces.groupBy("target_id", "doc_id").agg(F.sum("tokens").alias("n"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.count(F.lit(1)).alias("parts"), F.count_distinct("first_token").alias("starts"), F.min("first_token").alias("begin"))
    listed = F.array(*[F.struct(F.lit(r[0]).alias("target_id"), F.lit(r[1]).alias("capacity_tokens")) for r in t.collect()])  # a small table
    wanted = sizes.where("tokens > 0").select("doc_id", "tokens", F.inline(listed))
    both = wanted.join(docs, ["target_id", "doc_id"], "full")
    needed = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    right = (F.col("n") == F.col("tokens")) & (F.col("end") == F.col("tokens")) & (F.col("begin") == 0) & (F.col("parts") == needed) & (F.col("starts") == needed)
    wrong = both.groupBy("target_id").agg(F.count("n").alias("n_documents"), F.count_if(~F.coalesce(right, F.lit(False))).alias("wrong_documents"))
    return t.join(wrong, "target_id").join(over, "target_id").select("target_id", "capacity_tokens", "n_documents", "over_capacity", "wrong_documents")


def packing_summary(pieces: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: target_id, capacity_tokens, n_containers, n_documents, n_pieces, n_tokens, filled (share of the containers' space)."""
    per = pieces.groupBy("target_id", "container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("p")).groupBy("target_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("p").alias("n_pieces"), F.sum("t").alias("n_tokens"))
    docs = pieces.select("target_id", "doc_id").distinct().groupBy("target_id").agg(F.count(F.lit(1)).alias("n_documents"))
    out = per.join(docs, "target_id").join(targets.select("target_id", "capacity_tokens"), "target_id")
    return out.select("target_id", "capacity_tokens", "n_containers", "n_documents", "n_pieces", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("filled"))
