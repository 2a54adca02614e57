"""Evaluation items inside corpus documents, found by template windows and checked word by word.

Texts are reduced to templates: names, numbers and units become typed
placeholders. Windows of ``WINDOW`` template words of the items form a hash
table that the documents' windows are joined with. The pairs it gives are
compared whole: where an item's windows hit, the
words behind the placeholders are compared: a copy keeps them, a
re-parameterised question replaces them by others of the same type. Pairs with
enough agreement are aligned word by word.

Documents are read and coded once, whatever the number of items: a bit filter
of fixed size tells which of their windows any item has, and only documents
with such a window are written and joined.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.storage import join_checked, materialize

WINDOW = 5
#: Items above which a window is common: it may be left out where an item is sought.
FREQUENT = 200
#: The class of a word, in the lowest two bits of its code.
PLAIN, NAME, NUMBER, UNIT = 0, 1, 2, 3
#: Bits of the filters of names and of windows, which every task holds; full filters only let more words pass as names and more documents be compared.
LOG2_NAMES, LOG2_WINDOWS = 20, 24
#: English number words and the units that may follow them.
UNITS_OF_NUMBER = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen").split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_VALUES = {w: i for i, w in enumerate(UNITS_OF_NUMBER)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)}
UNITS = frozenset("second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent metre metres meter meters mile miles kilometre kilometres gram grams kilo kilos litre litres token tokens".split())

_TAG = re.compile(r"<[^<>]{0,200}>")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_DIGIT = re.compile(r"\d")
_STARTS = re.compile(r"(^|[.!?:;(\"“])\s*$")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-case words without markup; numbers, in digits or words, as ``#value``."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    found = _WORD.findall(text.lower())
    if NUMBER_VALUES.keys().isdisjoint(found) and not _DIGIT.search(text):
        return found
    out: list[str] = []
    tens = False
    for w in found:
        value = NUMBER_VALUES.get(w)
        if value is None:
            if w.isdigit():
                out.append("#" + str(int(w)) if len(w) < 19 else "#" + w)
            else:
                out.append(w)
            tens = False
        elif tens and 0 < value < 10:
            out[-1] = f"#{int(out[-1][1:]) + value}"
            tens = False
        else:
            out.append(f"#{value}")
            tens = value >= 20
    return out


def capitals_of(text: str) -> dict[str, tuple[bool, bool]]:
    """Each word of a text: whether it is capitalised somewhere inside a sentence, and whether it is in lower case anywhere."""
    out: dict[str, tuple[bool, bool]] = {}
    for m in _WORD.finditer(text):
        w = m.group()
        inside, lower = out.get(w.lower(), (False, False))
        if not w[0].isupper():
            lower = True
        elif not inside:
            inside = not _STARTS.search(text[max(0, m.start() - 20) : m.start()])
        out[w.lower()] = inside, lower
    return out


def bit_filter(hashes: DataFrame, log2_bits: int) -> np.ndarray:
    """Bit filter of the hashes (column h); at most 2**log2_bits bits come to the driver, however many hashes there are."""
    place = F.shiftrightunsigned("h", 2).bitwiseAND(F.lit((1 << log2_bits) - 1))
    words = hashes.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 2) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(1 << (log2_bits - 6), np.uint64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.int64).view(np.uint64)
    return bits


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(2)) & np.uint64(len(bits) * 64 - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def name_filter(items: DataFrame, text: str) -> np.ndarray:
    """Filter of the words that are always capitalised in the items, and at least once inside a sentence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, tuple[bool, bool]] = {}
            for t in batch["t"]:
                for w, (inside, lower) in capitals_of(t).items():
                    x = found.get(w, (False, False))
                    found[w] = x[0] or inside, x[1] or lower
            names = [w for w in found if w not in NUMBER_VALUES]
            yield pd.DataFrame({"h": np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64).view(np.int64), "inside": [found[w][0] for w in names], "lower": [found[w][1] for w in names]})

    each = items.select(F.col(text).alias("t")).mapInPandas(run, "h long, inside boolean, lower boolean")
    return bit_filter(each.groupBy("h").agg(F.max("inside").alias("i"), F.max("lower").alias("l")).where("i and not l").select("h"), LOG2_NAMES)


class WordCodes:
    """64-bit codes of words, the lowest two bits being their class; kept for those seen."""

    def __init__(self, names: np.ndarray) -> None:
        self.names = names
        self.known: dict[str, int] = {}

    def code(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if word[0] == "#":
            kind = NUMBER
        elif word in UNITS:
            kind = UNIT
        else:
            place = h >> 2 & len(self.names) * 64 - 1
            kind = NAME if int(self.names[place >> 6]) >> (place & 63) & 1 else PLAIN
        return h & ~3 | kind

    def __call__(self, words: Sequence[str]) -> list[int]:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.code(w)
        return [known[w] for w in words]


def templates(codes: np.ndarray) -> np.ndarray:
    """Codes with names, numbers and units reduced to their class."""
    kind = codes & np.uint64(3)
    return np.where(kind == PLAIN, codes, kind)


def window_keys(template: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """A 64-bit key of every window of template words."""
    n = len(template) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    t = template + np.uint64(5)
    key = np.full(n, size, np.uint64)
    for k in range(size):
        key = (key ^ t[k : k + n]) * _MIX
        key ^= key >> np.uint64(29)
    return key


def item_keys(template: np.ndarray) -> np.ndarray:
    """The keys of an item's windows; of an item shorter than a window the one key of the whole."""
    return window_keys(template, min(WINDOW, len(template))) if len(template) else np.zeros(0, np.uint64)


def align(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Best local alignment of two id sequences (1 for equal words, -1 for others and gaps): score and the aligned places in a and b."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0, np.zeros(0, int), np.zeros(0, int)
    h = np.zeros((n + 1, m + 1), np.int32)
    ramp = np.arange(1, m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = np.maximum(h[i - 1, :-1] + np.where(b == a[i - 1], 1, -1), h[i - 1, 1:] - 1)
        np.maximum(row, 0, out=row)
        h[i, 1:] = np.maximum.accumulate(row + ramp) - ramp
    i, j = np.unravel_index(h.argmax(), h.shape)
    score = float(h[i, j])
    at, bt = [], []
    while h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1):
            i, j = i - 1, j - 1
            at.append(i)
            bt.append(j)
        elif h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return score, np.array(at[::-1], int), np.array(bt[::-1], int)


def dense_parts(item: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray, least: int, density: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """An alignment (places a, b), or where too few of its words in either text are equal, its one or two dense parts, in order, with the most equal words.

    Parts start and end with equal words and hold at least ``least``. Parts
    are sought between all runs of equal words, so any gap may be left out.
    """
    same = item[a] == doc[b]
    # runs of equal words that follow one another in both texts
    at = np.flatnonzero(same)
    if not len(at):
        return []
    new = np.flatnonzero((np.diff(a[at]) > 1) | (np.diff(b[at]) > 1)) + 1
    first, last = np.r_[at[0], at[new]], np.r_[at[new - 1], at[-1]]
    equal = np.cumsum(same)
    n = equal[last][None, :] - equal[first][:, None] + 1  # equal words from run i to run j
    span = a[last][None, :] - a[first][:, None] + 1
    n = np.where((n >= np.maximum(least, density * span)) & (span > 0), n, 0)
    if n[0, -1]:
        return [(a, b)]
    upto = np.maximum.accumulate(n.max(axis=0))  # most in a part that ends at run j or before
    onward = np.maximum.accumulate(n.max(axis=1)[::-1])[::-1]
    both = np.r_[upto[:-1] + onward[1:], upto[-1]]
    cut = int(both.argmax())
    found = []
    for lo, hi in ((0, cut + 1), (cut + 1, len(first))):
        part = n[lo:hi, lo:hi]
        if part.size and part.max():
            i, j = np.unravel_index(part.argmax(), part.shape)
            x = slice(first[lo + i], last[lo + j] + 1)
            found.append((a[x], b[x]))
    return found


def stretches(item: np.ndarray, doc: np.ndarray, least: int = 5, density: float = 0.8) -> list[tuple[np.ndarray, np.ndarray]]:
    """The one or two best stretches, in the item's order in both texts, with at least ``least`` words and ``density`` of equal ones.

    The best alignment may bridge a gap between two stretches; it is then
    divided. What lies before, between and after is searched for a second one.
    """
    _, a, b = align(item, doc)
    if not len(a):
        return []
    equal = lambda x: int((item[x[0]] == doc[x[1]]).sum())

    def rest(lo: int, hi: int, dlo: int, dhi: int) -> list[tuple[np.ndarray, np.ndarray]]:
        x, y = item[lo:hi], doc[dlo:dhi]
        if len(x) < least or np.isin(x, y).sum() < least:
            return []
        _, p, q = align(x, y)
        return dense_parts(item, doc, p + lo, q + dlo, least, density) if len(p) else []

    found = dense_parts(item, doc, a, b, least, density)
    main = found or [(a, b)]
    end = main[-1]
    found = found + rest(0, main[0][0][0], 0, main[0][1][0]) + rest(end[0][-1] + 1, len(item), end[1][-1] + 1, len(doc))
    for one, two in zip(main, main[1:]):
        found += rest(one[0][-1] + 1, two[0][0], one[1][-1] + 1, two[1][0])
    return sorted(sorted(found, key=equal, reverse=True)[:2], key=lambda x: x[0][0])


@dataclass
class Limits:
    """share: of the item's words that must be found; density: of a stretch's item words; swaps: share of a stretch's words that may be slots filled otherwise; screen: share of the item covered by equal words in hit windows that makes a pair be aligned; least: words of a stretch."""

    share: float = 0.5
    density: float = 0.8
    swaps: float = 0.05
    screen: float = 0.3
    least: int = 5


def match_pair(item: np.ndarray, ids: np.ndarray, limits: Limits) -> tuple[float, float, int, str] | None:
    """An item in a document, both as codes: (share of its words, share of slots that agree, stretches, kind), or None.

    kind is ``copy`` where the share counts, ``variant`` where at least that
    share of the item's template is there but its slots are filled otherwise.
    An item shorter than a window is found where the document holds all of it, one word after another.
    """
    size = min(WINDOW, len(item))
    item_template, types = templates(item), templates(ids)
    keys, own = window_keys(item_template, size), window_keys(types, size)
    order = np.argsort(keys, kind="stable")
    left = np.searchsorted(keys[order], own, "left")
    reps = np.searchsorted(keys[order], own, "right") - left
    hit = np.flatnonzero(reps)
    if not len(hit):
        return None
    reps = reps[hit]
    p = order[np.repeat(left[hit], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
    w = np.repeat(hit, reps)
    template, equal = np.zeros(len(item), bool), np.zeros(len(item), bool)
    whole = np.ones(len(p), bool)
    for k in range(size):
        template[p + k] = True
        same = item[p + k] == ids[w + k]
        whole &= same
        equal[(p + k)[same]] = True
    if len(item) < WINDOW:
        return (1.0, 1.0, 1, "copy") if whole.any() else (1.0, float(equal.mean()), 0, "variant")
    if template.mean() < limits.screen:
        return None
    if equal.mean() >= limits.screen:
        lo, hi = max(0, w.min() - len(item)), w.max() + WINDOW + len(item)
        near, kinds = ids[lo:hi], types[lo:hi]
        # in stretches this dense most equal words follow one another, a fifth of them being altered or followed by insertions
        pairs = np.isin(item[:-1] * _MIX ^ item[1:], near[:-1] * _MIX ^ near[1:]).sum()
        if pairs >= (2 - 1 / limits.density) * limits.share * 0.8 * len(item) - 2:
            good, used, agree, slots = 0, 0, 0, 0
            for a, b in stretches(item, near, limits.least, limits.density):
                same = item[a] == near[b]
                slot = (item_template[a] <= UNIT) & (kinds[b] == item_template[a])
                agree += int((slot & same).sum())
                slots += int(slot.sum())
                span = a[-1] - a[0] + 1
                if same.sum() >= max(limits.least, limits.density * span) and (slot & ~same).sum() < limits.swaps * span:
                    good += int(same.sum())
                    used += 1
            if good >= limits.share * len(item):
                return good / len(item), agree / slots if slots else 1.0, used, "copy"
    if template.mean() >= limits.share:
        return float(template.mean()), float(equal[template].mean()), 0, "variant"
    return None


def coded_items(items: DataFrame, names: np.ndarray) -> DataFrame:
    """Of items (item_id, t): item_id, codes, keys; items without words are left out."""
    held = items.sparkSession.sparkContext.broadcast(names)  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = WordCodes(held.value)
        for batch in batches:
            codes = [np.array(coder(words_of(t)), np.uint64) for t in batch["t"]]
            out = [(i, c.view(np.int64), item_keys(templates(c)).view(np.int64)) for i, c in zip(batch["item_id"], codes) if len(c)]
            yield pd.DataFrame(out, columns=["item_id", "codes", "keys"])

    return items.mapInPandas(run, "item_id long, codes array<long>, keys array<long>")


def coded_documents(documents: DataFrame, names: np.ndarray, windows: np.ndarray, sizes: Sequence[int]) -> DataFrame:
    """Of documents (doc_id, t) those with a window that is in the filter ``windows``: doc_id, uid (a hash of the text), codes, keys (of these windows, distinct). Whole texts are read, once."""
    held = documents.sparkSession.sparkContext.broadcast((names, windows))  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, windows = held.value
        coder = WordCodes(names)

        def some(ids: list, uids: list, codes: list[int], ends: list[int]) -> pd.DataFrame:
            flat = np.array(codes, np.uint64)
            end = np.array(ends)
            start = np.r_[0, end[:-1]]
            owner = np.repeat(np.arange(len(ids)), end - start)
            kinds = templates(flat)
            at, got = [], []
            for size in sizes:
                keys = window_keys(kinds, size)
                hit = np.flatnonzero(in_filter(windows, keys))
                hit = hit[owner[hit] == owner[hit + size - 1]]  # inside one document
                at.append(owner[hit])
                got.append(keys[hit])
            at, got = np.concatenate(at), np.concatenate(got)
            order = np.argsort(at, kind="stable")
            at, got = at[order], got[order]
            docs, first = np.unique(at, return_index=True)
            parts = np.split(got, first[1:])
            return pd.DataFrame(
                {
                    "doc_id": [ids[d] for d in docs],
                    "uid": [uids[d] for d in docs],
                    "codes": pd.Series([flat[start[d] : end[d]].view(np.int64) for d in docs], dtype=object),
                    "keys": pd.Series([np.unique(k).view(np.int64) for k in parts[: len(docs)]], dtype=object),
                }
            )

        for batch in batches:
            ids, uids, codes, ends = [], [], [], []
            for d, u, t in zip(batch["doc_id"], batch["uid"], batch["t"]):
                ids.append(d)
                uids.append(u)
                codes += coder(words_of(t))
                ends.append(len(codes))
                if len(codes) > 400_000:
                    yield some(ids, uids, codes, ends)
                    ids, uids, codes, ends = [], [], [], []
            if codes:
                yield some(ids, uids, codes, ends)

    rows = documents.select("doc_id", F.xxhash64("t").alias("uid"), "t")
    return rows.mapInPandas(run, "doc_id long, uid long, codes array<long>, keys array<long>")


def probe_windows(items: DataFrame, screen: float) -> DataFrame:
    """The windows by which items are sought: key, item_id, n (words of the item), left (words that windows left out cover), and the words that the window covers in the item, as bits of a block of 64: block, bits.

    A document must have windows over ``screen`` of an item's words. So the
    item's most frequent windows among the items may be left out as long as they cover less than
    that: whatever else a document shares with it, it shares one of the others. Phrases common to many items
    then bring few pairs, and none is lost.
    """
    each = items.select("item_id", F.size("codes").alias("n"), F.posexplode("keys").alias("place", "key"))
    frequency = each.groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    windows = each.join(frequency, "key").groupBy("item_id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "place", "key"))).alias("w"))  # one entry a word of the item

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, n, own in zip(batch["item_id"], batch["n"], batch["w"]):
                own = list(own)
                covered, left = np.zeros(n, bool), 0
                while len(own) > 1 and own[-1]["f"] > FREQUENT:
                    p = own[-1]["place"]
                    covered[p : p + WINDOW] = True
                    if covered.sum() >= screen * n:
                        break
                    left = int(covered.sum())
                    own.pop()
                words: dict[tuple[int, int], int] = {}
                for x in own:
                    for w in range(x["place"], min(n, x["place"] + WINDOW)):
                        words[x["key"], w >> 6] = words.get((x["key"], w >> 6), 0) | 1 << (w & 63)
                out += [(k, i, n, left, block, bits - (bits >> 63 << 64)) for (k, block), bits in words.items()]
            yield pd.DataFrame(out, columns=["key", "item_id", "n", "left", "block", "bits"])

    return windows.mapInPandas(run, "key long, item_id long, n int, left int, block int, bits long")


def find_leaks(documents: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column, limits: Limits | None = None, variants: bool = True) -> DataFrame:
    """Documents that hold items: doc_id, item_id, share, slot_agreement, stretches, kind.

    Neither side comes to the driver: the items' windows are a table that the
    documents' windows are joined with; the pairs it gives are joined with the
    codes of both and compared whole, if the shared windows cover enough of the item. Texts that occur in several documents are compared once. Repeated rows give one
    row; a doc_id with several texts one for each that differs in the result. Null, empty texts, rows
    without id and texts without words give none. Extra columns don't matter.
    """
    limits = limits or Limits()
    wanted = materialize(items.select(item_id.cast("long").alias("item_id"), item_text.alias("t")).where(F.col("t").isNotNull() & F.col("item_id").isNotNull()).distinct(), "items")
    names = name_filter(wanted, "t")
    coded = materialize(coded_items(wanted, names).withColumn("item", F.xxhash64("item_id", "codes")), "coded-items")
    keys = coded.select(F.explode("keys").alias("h")).distinct()
    sizes = sorted(r[0] for r in coded.select(F.least(F.size("codes"), F.lit(WINDOW)).alias("s")).distinct().collect()) or [WINDOW]  # at most WINDOW values
    probe = documents.select(doc_id.cast("long").alias("doc_id"), text.alias("t")).where(F.col("t").isNotNull() & F.col("doc_id").isNotNull())
    found = materialize(coded_documents(probe, names, bit_filter(keys, LOG2_WINDOWS), sizes), "coded-documents")
    windows = materialize(probe_windows(coded.select(F.col("item").alias("item_id"), "codes", "keys"), limits.screen), "windows")
    hits = found.select("uid", F.explode("keys").alias("key")).distinct()
    by = ["uid", F.col("item_id").alias("item"), "n", "left"]
    reached = join_checked(hits, windows, ["key"], "inner").groupBy(*by, "block").agg(F.bit_or("bits").alias("bits"))
    covered = reached.groupBy("uid", "item", "n", "left").agg(F.sum(F.bit_count("bits")).alias("covered"))
    pairs = materialize(covered.where((F.col("n") < WINDOW) | (F.col("covered") + F.col("left") >= limits.screen * F.col("n"))).select("uid", "item"), "pairs")
    texts = join_checked(found, materialize(pairs.select("uid").distinct(), "uids"), ["uid"], "left_semi").select("uid", "codes").dropDuplicates(["uid"])
    both = join_checked(pairs, materialize(coded.select("item", "item_id", F.col("codes").alias("item_codes")), "item-codes"), ["item"], "inner").join(texts, "uid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for u, i, c, d in zip(batch["uid"], batch["item_id"], batch["item_codes"], batch["codes"]):
                m = match_pair(c.view(np.uint64), d.view(np.uint64), limits)
                if m and (variants or m[3] == "copy"):
                    out.append((u, i, *m))
            yield pd.DataFrame(out, columns=["uid", "item_id", "share", "slot_agreement", "stretches", "kind"])

    matched = both.select("uid", "item_id", "item_codes", "codes").mapInPandas(run, "uid long, item_id long, share double, slot_agreement double, stretches int, kind string")
    matched = materialize(matched, "matched")
    return join_checked(found.select("doc_id", "uid"), matched, ["uid"], "inner").drop("uid").distinct()
