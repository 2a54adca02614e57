"""Language of texts and of the parts of mixed texts, by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds, for every n-gram, the set of languages that
contain it: a cell is a bitmask of languages, and the cells of an n-gram's
hashes, combined with AND, give all its languages at once. The bits of a
language counted over a text's n-grams (popcount), less the share that the
filter's false positives explain, are its evidence. Parts of a text are the
best path through the evidence of its words with a price on changing the language.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "es", "fr", "de", "pt")
#: Names and three-letter codes under which a language may be labelled.
LABEL_NAMES = {
    "eng": "en", "english": "en", "spa": "es", "spanish": "es", "español": "es", "espanol": "es", "castellano": "es",
    "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr",
    "deu": "de", "ger": "de", "german": "de", "deutsch": "de",
    "por": "pt", "portuguese": "pt", "português": "pt", "portugues": "pt",
}

_NOISE = re.compile(r"<[^>\s]{0,80}>|https?://\S+|www\.\S+|\S*\.(?:example|invalid|com|org|net)/?\S*|[@#]\w+|&\w+;|^\s*RT\b", re.I)
_NOISY = re.compile(r"[<@#&]|://|www\.|\.(?:example|invalid|com|org|net)|^\s*RT\b", re.I)  # texts without any of these have no noise
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LONG = re.compile(r"(.)\1{2,}")


def label_language(label: Column) -> Column:
    """The language a label names, in lower case without region (``en_GB`` and ``EN`` give ``en``); text that names none stays as it is."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^([^-_]*)", 1)
    names = F.create_map(*[F.lit(x) for pair in LABEL_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, first), first)


def fold(word: str) -> str:
    """Lower case without accents, letters repeated three times or more once."""
    word = unicodedata.normalize("NFD", word.lower().replace("’", "'"))
    return _LONG.sub(r"\1", "".join(c for c in word if not unicodedata.combining(c)))


def plain_of(text: str) -> str:
    """The text with entities decoded, and links, handles, tags and the mark of a shared message blanked out."""
    if "&" in text:
        text = html.unescape(text)
    return _NOISE.sub(lambda m: " " * (m.end() - m.start()), text) if _NOISY.search(text) else text


def words_of(text: str) -> list[str]:
    """The words of a text, without noise."""
    return _WORD.findall(plain_of(text))


def places_of(text: str) -> list[tuple[int, int]]:
    """Start and end of each word in the text with entities decoded."""
    return [m.span() for m in _WORD.finditer(plain_of(text))]


def ngrams_of(word: str, sizes: Sequence[int] = (2, 3, 4)) -> list[str]:
    """The folded word itself and the letter n-grams of it with its ends marked."""
    marked = f"^{word}$"
    grams = ["=" + word]
    for n in sizes:
        grams += [marked[i : i + n] for i in range(len(marked) - n + 1)]
    return grams


@dataclass
class LanguageFilter:
    """cells: bitmask per cell; hashes: probes an n-gram; wrong: chance that an unseen n-gram shows a language."""

    languages: tuple[str, ...]
    cells: np.ndarray
    hashes: int
    wrong: np.ndarray

    def places(self, gram: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(gram)
        a, b = h & 0xFFFFFFFFFFFFFFFF, (h >> 64) | 1
        return [(a + i * b) % len(self.cells) for i in range(self.hashes)]

    def mask(self, gram: str) -> int:
        """The bitmask of languages that contain the n-gram."""
        m = -1
        for p in self.places(gram):
            m &= int(self.cells[p])
        return m

    def corrected(self, popcount: np.ndarray) -> np.ndarray:
        """Mean popcounts (0 to 1 a language) without the share that the filter's false positives explain: an absent n-gram shows a language with the chance ``wrong``."""
        return np.clip((popcount - self.wrong) / (1 - self.wrong), 0, 1)


class WordScores:
    """The evidence of words per language, each word scored once; bounded by ``most`` words and n-grams, after which it starts anew."""

    def __init__(self, model: LanguageFilter, most: int = 300_000) -> None:
        self.model, self.most = model, most
        self.masks: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.evidence = np.zeros((0, len(self.model.languages)))

    def places(self, words: Sequence[str]) -> np.ndarray:
        """Rows of ``evidence`` for the words, which holds until the next call."""
        if len(self.place) > self.most:
            self.clear()
        unseen = list(dict.fromkeys(w for w in words if w not in self.place))
        if unseen:
            n = len(self.place)
            self.place.update(zip(unseen, range(n, n + len(unseen))))
            self.evidence = np.concatenate([self.evidence, self.score(unseen)])
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def score(self, words: Sequence[str]) -> np.ndarray:
        """Corrected popcounts of the words' n-grams, the whole word counting as half."""
        masks = self.masks
        if len(masks) > self.most:
            masks.clear()
        grams = [ngrams_of(fold(w)) for w in words]
        for g in {g for own in grams for g in own}.difference(masks):
            masks[g] = self.model.mask(g)
        flat = np.array([masks[g] for own in grams for g in own], np.uint64)
        bits = (flat[:, None] >> np.arange(len(self.model.languages), dtype=np.uint64) & np.uint64(1)).astype(float)
        size = np.fromiter(map(len, grams), np.int64, len(grams))
        start = np.cumsum(size) - size
        letters = (np.add.reduceat(bits, start) - bits[start]) / np.maximum(size - 1, 1)[:, None]
        return self.model.corrected((bits[start] + letters) / 2)


def build_filter(texts: Iterable[tuple[str, str]], languages: Sequence[str] = LANGUAGES, log2_cells: int = 20, hashes: int = 4, least: int = 3, share: float = 0.3) -> LanguageFilter:
    """Filter from (language, text) pairs.

    Labels may be wrong and texts mixed: an n-gram belongs to a language if it
    occurs there at least ``least`` times and at least ``share`` times as often,
    relative to the language's n-grams, as where it is most frequent.
    """
    words = {l: Counter() for l in languages}
    for lang, text in texts:
        if lang in words and text:
            words[lang].update(words_of(text))
    counts = {l: Counter() for l in languages}
    for l, c in words.items():
        for w, n in c.items():
            for g in set(ngrams_of(fold(w))):
                counts[l][g] += n
    totals = {l: max(1, sum(c.values())) for l, c in counts.items()}
    cells = np.zeros(1 << log2_cells, np.uint8 if len(languages) <= 8 else np.uint64)
    made = LanguageFilter(tuple(languages), cells, hashes, np.zeros(len(languages)))
    most: dict[str, float] = {}
    for l, c in counts.items():
        for g, n in c.items():
            most[g] = max(most.get(g, 0.0), n / totals[l])
    for k, l in enumerate(languages):
        for g, n in counts[l].items():
            if n >= least and n / totals[l] >= share * most[g]:
                for p in made.places(g):
                    cells[p] |= cells.dtype.type(1 << k)
    fill = np.array([np.count_nonzero(cells >> np.uint8(k) & np.uint8(1)) / len(cells) for k in range(len(languages))])
    made.wrong = fill**hashes
    return made


def fit_filter(labelled: DataFrame, text: Column, label: Column, per_language: int = 8_000, languages: Sequence[str] = LANGUAGES) -> LanguageFilter:
    """Filter from a bounded sample: of each language the ``per_language`` distinct texts of lowest hash whose label names it. The bound is about the most the driver holds.

    Labels are counted first; then one pass takes, of every language, the
    texts whose hash lies in the part of the range that holds a little more than ``per_language`` of them.
    """
    rows = labelled.select(text.alias("t"), label_language(label).alias("l")).where(F.col("t").isNotNull() & F.col("l").isin(*languages))
    n = {r.l: r.n for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = {l: min(1.0, (1.2 * per_language + 100) / c) for l, c in n.items()}
    if not part:
        return build_filter([], languages)
    bound = F.create_map(*[x for l, p in part.items() for x in (F.lit(l), F.lit(int(p * (1 << 62))))])
    h = F.xxhash64("t").bitwiseAND(F.lit((1 << 62) - 1))
    taken = rows.withColumn("h", h).where(F.col("h") <= bound[F.col("l")]).distinct().collect()
    kept: list[tuple[str, str]] = []
    for l in sorted(part):
        kept += [(l, r.t) for r in sorted((r for r in taken if r.l == l), key=lambda r: (r.h, r.t))[:per_language]]
    return build_filter(kept, languages)


def best_path(evidence: np.ndarray, length: np.ndarray, price: float) -> np.ndarray:
    """Languages per word, for texts [text, word, language] padded to one length; a change of language costs ``price``."""
    b, t, k = evidence.shape
    back = np.zeros((b, t, k), np.int8)
    score = evidence[:, 0].copy()
    own = np.arange(k)
    for i in range(1, t):
        top = score.argmax(1)
        change = score[np.arange(b), top] - price
        stay = score >= change[:, None]
        back[:, i] = np.where(stay, own, top[:, None])
        new = np.where(stay, score, change[:, None]) + evidence[:, i]
        score = np.where((i < length)[:, None], new, score)
    path = np.zeros((b, t), np.int8)
    at = score.argmax(1)
    for i in range(t - 1, -1, -1):
        inside = i < length
        path[inside, i] = at[inside]
        at = np.where(inside, back[np.arange(b), i, at], at)
    return path


def paths_of(evidence: np.ndarray, size: np.ndarray, price: float) -> np.ndarray:
    """The language of every word of texts whose words' evidence lies one after another, ``size`` words a text."""
    start = np.cumsum(size) - size
    out = np.zeros(len(evidence), np.int8)
    order = np.flatnonzero(size)
    order = order[np.argsort(size[order], kind="stable")]
    at = 0
    while at < len(order):
        some = order[at : at + max(1, min(4096, 200_000 // int(size[order[at]])))]
        while len(some) > 1 and int(size[some[-1]]) * len(some) > 400_000:
            some = some[: len(some) // 2]
        at += len(some)
        longest = int(size[some[-1]])
        inside = np.arange(longest)[None, :] < size[some][:, None]
        rows = np.where(inside, start[some][:, None] + np.arange(longest), 0)
        path = best_path(np.where(inside[:, :, None], evidence[rows], 0.0), size[some], price)
        out[rows[inside]] = path[inside]
    return out


@dataclass
class Parts:
    """Parts of texts, in order: which text, its number there, language, confidence, and its first and last word in the text."""

    text: np.ndarray
    segment: np.ndarray
    language: np.ndarray
    confidence: np.ndarray
    first: np.ndarray
    last: np.ndarray


def parts_of(words: Sequence[Sequence[str]], scores: WordScores, price: float = 1.2) -> Parts:
    """The parts of texts given as words: stretches of the best path, whatever their length.

    A part's confidence is its mean evidence per word. Words at a part's ends that speak
    for another language are not counted, unless all do. Parts without any evidence are none.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    at = scores.places([w for own in words for w in own])
    if not len(at):
        none = np.zeros(0, np.int64)
        return Parts(none, none, none, np.zeros(0), none, none)
    e = scores.evidence[at]
    path = paths_of(e, size, price)
    text = np.repeat(np.arange(len(words)), size)
    begin = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (path[1:] != path[:-1])])
    end = np.r_[begin[1:], len(path)] - 1
    place = np.arange(len(path))
    own = e[place, path]
    speaks = own >= e.max(axis=1)
    first = np.minimum.reduceat(np.where(speaks, place, len(path)), begin)
    last = np.maximum.reduceat(np.where(speaks, place, -1), begin)
    silent = last < 0
    first, last = np.where(silent, begin, first), np.where(silent, end, last)
    upto = np.r_[0.0, np.cumsum(own)]
    sure = (upto[last + 1] - upto[first]) / (last - first + 1)
    kept = np.flatnonzero(sure > 1e-9)
    t = text[begin[kept]]
    new = np.r_[True, t[1:] != t[:-1]] if len(t) else np.zeros(0, bool)
    number = np.arange(len(t)) - np.maximum.accumulate(np.where(new, np.arange(len(t)), 0)) if len(t) else np.zeros(0, np.int64)
    offset = (np.cumsum(size) - size)[t]
    return Parts(t, number, path[begin[kept]], sure[kept], first[kept] - offset, last[kept] - offset)


def segment_languages(df: DataFrame, model: LanguageFilter, ids: Sequence[str], text: Column, with_text: bool = True, price: float = 1.2) -> DataFrame:
    """Parts of every text: ids, segment (from 0), lang, confidence, n_words, part (its text, null unless ``with_text``).

    Every text with a word that any language knows has a part, however short, with the confidence its words give; whether
    a part is a passage is for the reader to say. Repeated rows give repeated parts; null texts and texts without words give no row.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(model)  # of fixed size: its cells
    rows = df.select(*ids, text.alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = WordScores(held.value)
        names = np.array(held.value.languages, dtype=object)
        for batch in batches:
            texts = batch["_text"].tolist()
            p = parts_of([words_of(t) if isinstance(t, str) else () for t in texts], scores, price)
            if not len(p.text):
                continue
            out = batch[list(ids)].iloc[p.text].reset_index(drop=True)
            out["segment"], out["lang"], out["confidence"], out["n_words"] = p.segment, names[p.language], p.confidence, p.last - p.first + 1
            shown: list[str | None] = [None] * len(p.text)
            if with_text:
                at, places, plain = -1, [], ""
                for i, (t, a, b) in enumerate(zip(p.text, p.first, p.last)):
                    if t != at:
                        at, places, plain = t, places_of(texts[t]), html.unescape(texts[t])
                    shown[i] = plain[places[a][0] : places[b][1]]
            out["part"] = pd.Series(shown, dtype=object)
            yield out

    return rows.mapInPandas(run, f"{kinds}, segment int, lang string, confidence double, n_words int, part string")


def unlabelled_languages(segments: DataFrame, record: str, label: Column, least_words: int = 5, floor: float = 0.45) -> DataFrame:
    """Distinct (record, lang) of passages whose record's label doesn't name that language. A passage is a part of at least ``least_words`` words and a confidence of at least ``floor``."""
    named = F.coalesce(label_language(label), F.lit(""))
    passage = (F.col("n_words") >= least_words) & (F.col("confidence") >= floor)
    return segments.where(passage & F.col(record).isNotNull() & (named != F.col("lang"))).select(record, "lang").distinct()


def main_language(segments: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row a text: ids, lang (most words; ties by name), confidence (mean evidence weighted by words), languages, n_languages."""
    per = segments.groupBy(*ids, "lang").agg(F.sum("n_words").alias("n"), (F.sum(F.col("confidence") * F.col("n_words")) / F.sum("n_words")).alias("c"))
    best = F.max(F.struct("n", F.col("c"), "lang"))
    return per.groupBy(*ids).agg(best.alias("b"), F.array_sort(F.collect_set("lang")).alias("languages")).select(*ids, F.col("b.lang").alias("lang"), F.col("b.c").alias("confidence"), "languages", F.size("languages").alias("n_languages"))
