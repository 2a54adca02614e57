"""Texts that were cut: near-copies that go on where a text ends, and closing words that don't close.

What was appended after a cut (links, tags, emoji, marks of omission, a
signature, broken markup or characters) is set aside first. Texts that then end with a sentence's final mark are whole.
For the others, copies that contain them are found by min-hash banding, verified and
aligned: the copy whose alignment ends early, in mid-word or within a marked sentence of the longer one, is cut.
A longer copy without marks makes a cut likely. Without such evidence the terminality of the closing words decides: how often
the corpus ends a sentence after the same last words.

A cut copy may be much shorter than its original, so banding compares starts: of every text the min-hash
signatures of its first s words in shingles, for sizes s that grow by a quarter, of an open-ended text only that of the size just below its own.
All texts are tokenized twice: once for their ends, once to count closing contexts and to take the signatures, both by filters of fixed size.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.storage import join_checked, materialize

#: Closing words looked at, shingle length, least part of a text's shingles that a copy must hold, bands and rows of the min-hash signature.
CONTEXT, SHINGLE, SIMILAR, BANDS, ROWS = 8, 5, 0.8, 10, 3
#: Bits of the filter of closing contexts: what the driver and each executor hold is 2**LOG2_BITS / 8 bytes, whatever the corpus. A full filter only lets more contexts be counted.
LOG2_BITS = 25
#: The same for the buckets of open-ended texts' signatures; a full filter only lets more signatures be joined.
LOG2_BUCKETS = 24
#: Tokens that are worked on at a time.
AT_ONCE = 250_000
#: Terminality below which a text is cut; of texts at their source's length limit, or with a near-copy that goes on, where a cut is likely.
CUT_BELOW, CUT_BELOW_LIKELY = 0.025, 0.6

#: Tokens on either side of a text's end within which a longer copy that marks its sentences has a mark.
MARKED = 40
#: Lengths on either side that a length limit is compared with, how many times their count it has at least, and the least negative logarithm of the chance that so many texts end there.
AROUND, EXCESS, CHANCE = 20, 4, 14

_APPENDED = re.compile(
    r"""(?:\s*(?:https?://\S*|www\.\S+|[\w.-]+\.(?:example|invalid|com|org|net|io)/\S*|[#@]\w+|</?\w[^>]*>|(?:--|—)\s*\w+|<3|[:;=]['’]?-?[()DP/|]|[\U0001F000-\U0001FAFF☀-➿️‍]+|\[[^\]]{0,40}\]|\((?:more|continued|cont\.?|truncated|cut)\)|(?:read|see) more|\.\.+|…|�+))+\s*$""",
    re.I,
)
#: Characters at a text's end, filled up to a whole word, on which the patterns are tried at a time.
TAIL = 160
_BROKEN = re.compile(r"(?:&#?\w{0,8}|<[^>\s]{0,10}|�+)$")
_PLAIN_END = re.compile(r"(?:^|\s)[\w'’\-]*\w[.!?]\Z")
_FINAL = re.compile(r"[.!?。！？][\"'”’)\]]*$")
_TOKEN = re.compile(r"\n+|[.!?…]+(?=[\s\"')]|$)|,|[^\W_]+(?:['’\-][^\W_]+)*")
_LONG = re.compile(r"(\w)\1{2,}")
_STOP, _COMMA = np.uint64(1), np.uint64(3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def core_and_lengths(text: str) -> tuple[str, list[int]]:
    """The text without what may have been appended after a cut, and the lengths the text may have had before: with and without blanks after each part that comes off.

    The patterns look at the last whole words of the text, again and again until nothing more comes off.
    """
    core = text.rstrip()
    if _PLAIN_END.search(core):  # a word and a final mark: nothing to take off
        return core, []
    lengths = set()
    while core:
        at = max(core.rfind(" ", 0, -TAIL), core.rfind("\n", 0, -TAIL)) + 1 if len(core) > TAIL else 0
        tail = core[at:]
        short = _BROKEN.sub("", _APPENDED.sub("", tail)).rstrip()
        if short == tail:
            break
        before, core = core, (core[:at] + short).rstrip()
        rest = before[len(core) :]
        lengths |= {len(core), len(core) + len(rest) - len(rest.lstrip())}
    return core, sorted(lengths - {0, len(text)})


def core_of(text: str) -> str:
    """The text without what may have been appended after a cut."""
    return core_and_lengths(text)[0]


def is_final(core: str) -> bool:
    return bool(_FINAL.search(core))


def tokens_of(text: str) -> list[str]:
    """Lower-case words and commas; ``\\n`` stands for any final mark or line break."""
    text = (html.unescape(text) if "&" in text else text).lower()
    if _LONG.search(text):
        text = _LONG.sub(r"\1", text)
    all_ = ["\n", *["\n" if x[0] in "\n.!?…" else x for x in _TOKEN.findall(text)]]
    return ["\n", *[x for x, before in zip(all_[1:], all_) if x != "\n" or before != "\n"]]


_MARKS = {"\n": 1, ",": 3}
#: Between tokens that are kept as one text; no token holds it.
_BETWEEN = "\x1f"


class Hasher:
    """64-bit hashes of tokens, kept for those seen."""

    def __init__(self) -> None:
        self.known: dict[str, int] = dict(_MARKS)

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
            known.update(_MARKS)
        for t in set(tokens).difference(known):
            known[t] = xxhash.xxh64_intdigest(t) | 4
        return np.array([known[t] for t in tokens], np.uint64)


def contexts(h: np.ndarray, size: int = CONTEXT) -> list[np.ndarray]:
    """For k = 1..size the hash of the k tokens that end at each place (0 where there are fewer)."""
    out, cur = [], np.zeros(len(h), np.uint64)
    for k in range(size):
        back = np.zeros(len(h), np.uint64)
        back[k:] = h[: max(0, len(h) - k)]
        cur = (cur ^ (back + np.uint64(k))) * _MIX
        cur ^= cur >> np.uint64(31)
        valid = cur.copy()
        valid[:k] = 0
        out.append(valid)
    return out


def sizes_upto(n: int) -> np.ndarray:
    """The sizes at which starts of texts are compared: 1, and each greater by a quarter (at least by one), up to n."""
    out = [1]
    while (x := max(out[-1] + 1, int(out[-1] / SIMILAR))) <= n:
        out.append(x)
    return np.array(out)


_RNG = np.random.default_rng(7)
_MULT = _RNG.integers(1, 2**63, BANDS * ROWS, np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64)


def start_signatures(shingles: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket keys [signature, band] of the starts of texts whose shingles lie one after another, ``count`` a text; with each signature's text and size.

    Of every text the starts of all ``sizes_upto`` its number of shingles.
    """
    sizes = sizes_upto(int(count.max(initial=0)))
    begin = np.cumsum(count) - count
    has = np.searchsorted(sizes, count, "right")  # sizes of each text
    text = np.repeat(np.arange(len(count)), has)
    which = np.arange(len(text)) - np.repeat(np.cumsum(has) - has, has)
    if not len(text):
        return np.zeros((0, BANDS), np.uint64), text, which
    # least hash between one size and the next, then of all up to it
    lower = np.r_[0, sizes[:-1]][which]
    starts = begin[text] + lower
    ends = begin[text] + sizes[which]
    low = np.minimum.reduceat(shingles[:, None] * _MULT + _ADD, np.stack([starts, np.minimum(ends, len(shingles) - 1)], 1).ravel(), axis=0)[::2]
    at_end = ends == len(shingles)  # reduceat has no index past the end
    if at_end.any():
        for i in np.flatnonzero(at_end):
            low[i] = (shingles[starts[i] :, None] * _MULT + _ADD).min(axis=0)
    first = np.cumsum(has) - has
    for k in range(1, int(has.max())):
        rows = first[has > k] + k
        low[rows] = np.minimum(low[rows], low[rows - 1])
    rows = low.reshape(len(text), BANDS, ROWS)
    key = (sizes[which].astype(np.uint64) * _MIX)[:, None] + np.arange(BANDS, dtype=np.uint64)[None, :]
    for r in range(ROWS):
        key = (key ^ rows[:, :, r]) * _MIX
        key ^= key >> np.uint64(29)
    return key, text, sizes[which]


def closing_contexts(rows: DataFrame) -> DataFrame:
    """Of rows (uid, text): uid, final (ends with a final mark), ctx (hashes of its closing contexts, longest last; empty if final or without words), lengths (that it may have had before something was appended; empty if final), keys (buckets of its start, as long as it is but for a quarter; empty if final or of fewer than six words), tail (a hash of the three tokens before its last)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            final, ctx, lengths, count, shingles, tails = [], [], [], [], [], []
            for t in batch["text"]:
                core, before = core_and_lengths(t)
                done = not core or is_final(core)
                tokens = [] if done else tokens_of(core)
                while tokens and tokens[-1] == "\n":
                    tokens.pop()
                h = hasher(tokens) if any(x not in ("\n", ",") for x in tokens) else np.zeros(0, np.uint64)
                final.append(done)
                lengths.append([] if done else before)
                ctx.append([int(c[-1]) for c in (x.view(np.int64) for x in contexts(h[-CONTEXT:])) if c[-1]] if len(h) else [])
                own = word_shingles(h)[:-1] if len(h) else h  # the last word may be cut
                count.append(len(own))
                shingles.append(own)
                tails.append(int(triples(h[-4:])[2].view(np.int32)) if len(h) > 3 else 0)
            keys: list[list[int]] = [[] for _ in count]
            if sum(count):
                key, text, _ = start_signatures(np.concatenate(shingles), np.array(count))
                last = np.flatnonzero(np.r_[text[1:] != text[:-1], True])  # of each text its greatest size
                for i in last:
                    keys[text[i]] = key[i].view(np.int64).tolist()
            yield pd.DataFrame({"uid": batch["uid"], "final": final, "ctx": ctx, "lengths": lengths, "keys": keys, "tail": np.array(tails, np.int32)})

    return rows.select("uid", "text").mapInPandas(run, "uid long, final boolean, ctx array<long>, lengths array<int>, keys array<long>, tail int")


def triples(h: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the three tokens that end at each place."""
    return (contexts(h, 3)[-1] >> np.uint64(32)).astype(np.uint32)


def shift_of(n: int) -> int:
    """How many tokens further or nearer than in the text its end may be in a copy."""
    return max(5, n // 8)


def word_shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of SHINGLE words in a row, in order, of hashed tokens; marks don't count. None if there are fewer words."""
    words = h[(h != _STOP) & (h != _COMMA)]
    return contexts(words, SHINGLE)[-1][SHINGLE - 1 :]


def bit_filter(hashes: DataFrame, log2_bits: int = LOG2_BITS) -> np.ndarray:
    """Bit filter of the hashes (column h); at most 2**log2_bits bits come to the driver, however many hashes there are."""
    place = F.col("h").bitwiseAND(F.lit((1 << log2_bits) - 1))
    words = hashes.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(1 << (log2_bits - 6), np.uint64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.int64).view(np.uint64)
    return bits


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = h & np.uint64(len(bits) * 64 - 1)
    return (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)


def scan_texts(rows: DataFrame, bits: np.ndarray, buckets: np.ndarray) -> DataFrame:
    """All rows (uid, text) read whole, once, for two things: kind, h, a, b, w.

    ``context``: a context of the filter ``bits`` (h), how often it occurs (a), and how often a sentence ends after it (b).
    ``start``: a bucket of the filter ``buckets`` (h) that a start of the text uid (a) falls
    into, the hash of all that an open-ended text of that bucket may be compared with (b; texts with equal ones show the same), and
    the ``triples`` of the places before which such a text may end (w).
    """
    held = rows.sparkSession.sparkContext.broadcast((bits, buckets))  # of fixed size

    def some(uids: list[int], hashes: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        bits, buckets = held.value
        size = np.fromiter(map(len, hashes), np.int64, len(hashes))
        h = np.concatenate(hashes)
        begin = np.cumsum(size) - size
        place = np.arange(len(h)) - np.repeat(begin, size)
        inside = np.flatnonzero((h != _STOP) & (place < np.repeat(size, size) - 1))
        ends = h[np.minimum(inside + 1, len(h) - 1)] == _STOP
        found_h, found_e = [], []
        for k, c in enumerate(contexts(h)):
            c = c[inside]
            hit = in_filter(bits, c) & (place[inside] >= k) & (c != 0)
            found_h.append(c[hit])
            found_e.append(ends[hit])
        keys, at = np.unique(np.concatenate(found_h), return_inverse=True)
        yield pd.DataFrame({"kind": "context", "h": keys.view(np.int64), "a": np.bincount(at, minlength=len(keys)), "b": np.bincount(at, np.concatenate(found_e), len(keys)).astype(np.int64), "w": None})
        word = np.flatnonzero((h != _STOP) & (h != _COMMA))
        owner = np.repeat(np.arange(len(size)), size)
        words = np.bincount(owner[word], minlength=len(size))
        first = np.cumsum(words) - words
        nth = np.arange(len(word)) - np.repeat(first, words)
        shingles = contexts(h[word], SHINGLE)[-1][nth >= SHINGLE - 1]
        key, text, start = start_signatures(shingles, np.maximum(words - (SHINGLE - 1), 0))
        i, band = np.nonzero(in_filter(buckets, key.ravel()).reshape(key.shape))
        if not len(i):
            return
        # an open-ended text of the bucket ends before the next size but one; what follows within MARKED tokens counts too
        reach = (start[i] / SIMILAR / SIMILAR).astype(np.int64) + SHINGLE + 3
        t = text[i]
        last = np.where(reach < words[t], word[np.minimum(first[t] + reach, len(word) - 1)], begin[t] + size[t] - 1)
        last = np.minimum(last + MARKED, begin[t] + size[t] - 1)
        every = triples(h).view(np.int32)
        # tokens between the first and last end of such a text
        low = word[first[t] + np.minimum(start[i] + SHINGLE - 2, words[t] - 1)]
        low = np.maximum(begin[t] + 2, low - [shift_of(x) for x in (low - begin[t]).tolist()] - 1)
        high = np.where(reach < words[t], word[np.minimum(first[t] + reach, len(word) - 1)], begin[t] + size[t] - 1)
        high = np.minimum(begin[t] + size[t] - 1, high + [shift_of(x) for x in (high - begin[t]).tolist()])
        window = [every[x : y + 1] for x, y in zip(low.tolist(), high.tolist())]
        power = np.cumprod(np.full(int(size.max()), _MIX, np.uint64))
        upto = np.r_[np.uint64(0), np.cumsum(h * power[place], dtype=np.uint64)]
        region = upto[last + 1] - upto[begin[t]]
        yield pd.DataFrame({"kind": "start", "h": key[i, band].view(np.int64), "a": np.array(uids, np.int64)[t], "b": region.view(np.int64), "w": pd.Series(window, dtype=object)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            uids, hashes, n = [], [], 0
            for u, t in zip(batch["uid"], batch["text"]):
                h = hasher(tokens_of(core_of(t)))  # a mark of omission put after a cut is no end of a sentence
                if len(h) < 3:
                    continue
                uids.append(u)
                hashes.append(h)
                n += len(h)
                if n > AT_ONCE:
                    yield from some(uids, hashes)
                    uids, hashes, n = [], [], 0
            if uids:
                yield from some(uids, hashes)

    return rows.select("uid", "text").mapInPandas(run, "kind string, h long, a long, b long, w array<int>")


def context_counts(scanned: DataFrame) -> DataFrame:
    """h, n (occurrences), e (sentence ends after it) of all closing contexts."""
    return scanned.where("kind = 'context'").groupBy("h").agg(F.sum("a").alias("n"), F.sum("b").alias("e"))


def terminality(closing: DataFrame, counts: DataFrame, known: int = 3) -> DataFrame:
    """uid, terminality of texts with closing contexts.

    The chance that a sentence ends, from the last word to longer contexts,
    each smoothed by the one before (weight 1): p_k = (e_k + p_(k-1)) / (n_k + 1), from 0.1.
    A last word seen fewer than ``known`` times is half a word: 0. One that was
    never seen after the word before it is probably the start of another: a twentieth of the chance.
    """
    each = closing.where(F.size("ctx") > 0).select("uid", F.posexplode("ctx").alias("k", "h"))
    got = each.join(counts, "h", "left").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("e", F.lit(0)).alias("e")))).alias("s"))
    p = F.aggregate("s", F.lit(0.1), lambda acc, x: (x["e"] + acc) / (x["n"] + 1))
    unseen = F.coalesce(F.try_element_at("s", F.lit(2))["n"] == 0, F.lit(False))
    return got.select("uid", F.when(F.element_at("s", 1)["n"] < known, 0.0).when(unseen, p / 20).otherwise(p).alias("terminality"))


def copy_evidence(texts: DataFrame, closing: DataFrame, scanned: DataFrame) -> DataFrame:
    """Open-ended texts with a longer copy: uid, ends (``inside`` a sentence of the copy, or ``between`` two), shown (whether the copy settles it; see align_end()).

    ``texts`` has one row (uid, text) a distinct text. Each open-ended text is compared with the texts whose
    start of about its length shares a bucket and that have its last words where it may end, one for each distinct region:
    verified if they hold at least SIMILAR of its shingles, however long they are, then aligned by its last words.
    """
    probes = materialize(closing.where(F.size("keys") > 0).select("uid", "tail", F.explode("keys").alias("h")), "probes")
    longer = scanned.where("kind = 'start'").groupBy("h", "b", "w").agg(F.min("a").alias("longer"))
    goes_on = (F.col("uid") != F.col("longer")) & F.array_contains("w", F.col("tail"))
    pairs = materialize(join_checked(longer, probes, ["h"], "inner").where(goes_on).select("uid", "longer").distinct(), "pairs")
    sides = materialize(pairs.select("uid").unionByName(pairs.select(F.col("longer").alias("uid"))).distinct(), "sides")
    some = materialize(join_checked(texts, sides, ["uid"], "left_semi").dropDuplicates(["uid"]), "texts")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            tokens = [tokens_of(core_of(t)) for t in batch["text"]]
            yield pd.DataFrame({"uid": batch["uid"], "shingles": pd.Series([np.unique(word_shingles(hasher(x))).view(np.int64) for x in tokens], dtype=object), "tokens": [_BETWEEN.join(x) for x in tokens]})

    parsed = materialize(some.select("uid", "text").mapInPandas(parse, "uid long, shingles array<long>, tokens string"), "parsed")
    both = pairs.join(parsed, "uid").join(parsed.select(F.col("uid").alias("longer"), F.col("shingles").alias("longer_shingles"), F.col("tokens").alias("longer_tokens")), "longer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, ends, shown = [], [], []
            for u, a, x, b, y in zip(batch["uid"], batch["shingles"], batch["tokens"], batch["longer_shingles"], batch["longer_tokens"]):
                if e := align_end(a, x.split(_BETWEEN), b, y.split(_BETWEEN)):
                    ids.append(u)
                    ends.append(e[0])
                    shown.append(e[1])
            yield pd.DataFrame({"uid": np.array(ids, np.int64), "ends": pd.Series(ends, dtype=object), "shown": np.array(shown, bool)})

    found = both.select("uid", "shingles", "tokens", "longer_shingles", "longer_tokens").mapInPandas(run, "uid long, ends string, shown boolean")
    # one copy that shows a whole sentence is enough; one that only ends at the same place says less than one that goes on
    rank = F.when(F.col("ends") == "between", F.when(F.col("shown"), 0).otherwise(3)).otherwise(F.when(F.col("shown"), 1).otherwise(2))
    return found.groupBy("uid").agg(F.min(F.struct(rank.alias("rank"), "ends", "shown")).alias("best")).select("uid", "best.ends", "best.shown")


def align_end(a: np.ndarray, x: list[str], b: np.ndarray, y: list[str]) -> tuple[str, bool] | None:
    """Where a text's end lies in a copy: ``inside`` or ``between`` sentences, and whether that is settled; None if the other doesn't contain it or the end isn't found.

    ``between`` is settled unless the copy only ends at the same place, with
    other things appended; ``inside`` if the text ends in mid-word or the copy
    has marks on both sides within MARKED tokens. Without marks it may go on with the next sentence.
    a, x and b, y are distinct shingles and core's tokens of the text and of the other. The end is
    sought by its last four words, about as far from the start as in the text.
    """
    if not len(a) or len(b) < len(a) * SIMILAR or len(np.intersect1d(a, b, assume_unique=True)) < SIMILAR * len(a):
        return None
    x = x[: next((k for k in range(len(x), 0, -1) if x[k - 1] != "\n"), 0)]
    if len(x) < 4:
        return None
    tail, last, end = x[-4:-1], x[-1], len(x) - 1
    about = shift_of(len(x))
    near = []
    for i in range(max(0, end - 3 - about), min(len(y) - 3, end - 2 + about)):
        if y[i] == tail[0] and y[i + 1 : i + 3] == tail[1:] and y[i + 3].startswith(last):
            near.append((abs(i + 3 - end), i + 3))
    if not near:
        return None
    at = min(near)[1]
    if y[at] != last:
        return "inside", True
    if at + 1 >= len(y):
        return "between", False  # only what was appended is longer
    if y[at + 1] == "\n":
        return "between", True
    return "inside", "\n" in y[max(1, at - MARKED) : at] and "\n" in y[at + 1 : at + 1 + MARKED]


def far_above(counted: DataFrame, by: list[str]) -> DataFrame:
    """Of counts (by, length, n) those lengths whose n stands far above the AROUND lengths on either side: at least EXCESS times their mean and all but their three greatest counts, and too often for chance."""
    near = Window.partitionBy(*by).orderBy("length").rangeBetween(-AROUND, AROUND)
    rows = counted.withColumns({"all": F.sum("n").over(near), "ns": F.sort_array(F.collect_list("n").over(near), False)})
    mean = (F.col("all") - F.col("n") + 1) / (2 * AROUND)
    # the fifth greatest is the fourth of the neighbours if this length is among the greatest; lengths without texts count 0
    fourth = F.coalesce(F.try_element_at("ns", F.lit(5)), F.lit(0))
    chance = F.col("n") * F.log(F.col("n") / mean) - F.col("n") + mean  # of a Poisson tail: at most exp(-chance)
    return rows.where((F.col("n") >= EXCESS * F.greatest(mean, fourth)) & (chance >= CHANCE)).select(*by, "length")


def at_limits(rows: DataFrame, closing: DataFrame) -> DataFrame:
    """(uid, source) of open-ended texts that end at a length limit of their source, now or before something was appended.

    A limit is any length at which far more distinct open-ended texts end than
    at those around it, however many texts or limits a source has: the stored
    length first, then, for texts that have no such, the lengths before something was appended.
    """
    ends = rows.where(F.col("source").isNotNull()).select("uid", "source", "n_chars").distinct()
    ends = materialize(ends.join(closing.where(~F.col("final")).select("uid", "lengths"), "uid"), "ends")
    by = ["source", "appended"]

    def limits(each: DataFrame) -> DataFrame:
        return far_above(each.select(*by, "length", "uid").distinct().groupBy(*by, "length").agg(F.count(F.lit(1)).alias("n")), by)

    stored = ends.select("uid", "source", F.col("n_chars").alias("length")).withColumn("appended", F.lit(False))
    caps = materialize(limits(stored), "limits")
    on, key = ["source", "length"], ["uid", "source"]
    now = materialize(join_checked(stored, caps, on, "left_semi").select(*key).distinct(), "at_limit")
    before = join_checked(ends, now, key, "left_anti").select("uid", "source", F.explode("lengths").alias("length")).withColumn("appended", F.lit(True))
    caps = materialize(caps.select(*on).unionByName(limits(before).select(*on)).distinct(), "limits")
    return now.unionByName(join_checked(before, caps, on, "left_semi").select(*key)).distinct()


def text_rows(documents: DataFrame, doc_id: Column, text: Column, source: Column) -> DataFrame:
    """doc_id, uid (a hash of the text), text, source, n_chars; rows with an id and a text that isn't blank."""
    rows = documents.select(doc_id.cast("long").alias("doc_id"), F.xxhash64(text).alias("uid"), text.alias("text"), source.alias("source"), F.length(text).alias("n_chars"))
    return rows.where((F.length(F.trim("text")) > 0) & F.col("doc_id").isNotNull())


def judge_texts(documents: DataFrame, doc_id: Column, text: Column, source: Column) -> DataFrame:
    """Every row whose text is not null or empty: doc_id, source, final, at_limit, ends, terminality, cut.

    Each row is judged by its own text, also where ids repeat. Rows without id are left out. Repeated texts are judged each; null sources are one source of their own
    for shares, without a limit. An empty table gives an empty result.
    """
    rows = text_rows(documents, doc_id, text, source)
    closing = materialize(closing_contexts(rows).dropDuplicates(["uid"]), "closing")
    bits = bit_filter(closing.select(F.explode("ctx").alias("h")))
    buckets = bit_filter(closing.select(F.explode("keys").alias("h")), LOG2_BUCKETS)
    scanned = materialize(scan_texts(rows, bits, buckets), "scanned")
    scores = terminality(closing, context_counts(scanned))
    copies = copy_evidence(rows.select("uid", "text"), closing, scanned)
    limited = at_limits(rows, closing).withColumn("at_limit", F.lit(True))
    facts = closing.select("uid", "final").join(scores, "uid", "left").join(copies, "uid", "left")
    judged = rows.select("doc_id", "uid", "source").join(facts, "uid").join(limited, ["uid", "source"], "left")
    at_limit = F.coalesce("at_limit", F.lit(False))
    # a copy that goes on without marks counts as much as a length limit: it may go on with the next sentence
    bound = F.when(at_limit | (F.col("ends") == "inside"), CUT_BELOW_LIKELY).otherwise(CUT_BELOW)
    by_words = F.coalesce(F.col("terminality") < bound, F.lit(False))
    cut = ~F.col("final") & F.when(F.col("shown"), F.col("ends") == "inside").otherwise(by_words)
    return judged.select("doc_id", "source", "final", at_limit.alias("at_limit"), "ends", "terminality", cut.alias("cut"))


def cut_shares(judged: DataFrame) -> DataFrame:
    """Per source: source, n_texts, n_cut, share_cut."""
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut")).withColumn("share_cut", F.col("n_cut") / F.col("n_texts"))
