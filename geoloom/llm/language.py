"""Languages of documents and of their segments, whatever their labels say.

Each word of a body's paragraphs has a score per language. Its script narrows
the candidates first: only languages whose labelled texts are written in that
script come into question, so a word in Hangul is Korean if no other language
of the corpus uses it. A Viterbi pass over a document's words, with a penalty
for each switch that is smaller where a paragraph starts, then labels spans of
one language, so that names and shared words take the language around them.
Words of a script that no language of the corpus uses are undetermined, or of
the one language that writes this script.

The languages and their word scores are learned from a bounded sample of rows
whose label names one language. A label is believed to stand for a language of
its own if a model of one half of the sample recognises enough of the other
half's texts that bear it. Labels may be wrong and quoted text may be of another
language, so paragraphs are relabelled by the fitted scores and the scores
fitted again.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.mail import paragraphs, sentences

# Languages that a label may name, by their ISO 639 codes and English names.
LANGUAGES = {
    "af": ("af", "afr", "afrikaans"), "ar": ("ar", "ara", "arabic"), "bg": ("bg", "bul", "bulgarian"), "ca": ("ca", "cat", "catalan"),
    "cs": ("cs", "ces", "cze", "czech"), "da": ("da", "dan", "danish"), "de": ("de", "deu", "ger", "german"), "el": ("el", "ell", "gre", "greek"),
    "en": ("en", "eng", "english"), "es": ("es", "spa", "spanish"), "et": ("et", "est", "estonian"), "fi": ("fi", "fin", "finnish"),
    "fr": ("fr", "fra", "fre", "french"), "gl": ("gl", "glg", "galician"), "he": ("he", "heb", "hebrew"), "hi": ("hi", "hin", "hindi"),
    "hr": ("hr", "hrv", "croatian"), "hu": ("hu", "hun", "hungarian"), "id": ("id", "ind", "indonesian"), "it": ("it", "ita", "italian"),
    "ja": ("ja", "jpn", "japanese"), "ko": ("ko", "kor", "korean"), "lt": ("lt", "lit", "lithuanian"), "lv": ("lv", "lav", "latvian"),
    "nl": ("nl", "nld", "dut", "dutch"), "no": ("no", "nor", "norwegian"), "pl": ("pl", "pol", "polish"), "pt": ("pt", "por", "portuguese"),
    "ro": ("ro", "ron", "rum", "romanian"), "ru": ("ru", "rus", "russian"), "sk": ("sk", "slk", "slo", "slovak"), "sl": ("sl", "slv", "slovenian"),
    "sr": ("sr", "srp", "serbian"), "sv": ("sv", "swe", "swedish"), "th": ("th", "tha", "thai"), "tr": ("tr", "tur", "turkish"),
    "uk": ("uk", "ukr", "ukrainian"), "vi": ("vi", "vie", "vietnamese"), "zh": ("zh", "zho", "chi", "chinese"),
}
_NAMED = {name: code for code, names in LANGUAGES.items() for name in names}
# Languages that alone write a script, which goes by the first word of its letters' Unicode names.
SCRIPTS = {
    "HANGUL": "ko", "HIRAGANA": "ja", "KATAKANA": "ja", "GREEK": "el", "HEBREW": "he", "THAI": "th", "ARMENIAN": "hy", "GEORGIAN": "ka",
    "KHMER": "km", "LAO": "lo", "TAMIL": "ta", "TELUGU": "te", "SINHALA": "si", "GUJARATI": "gu", "MALAYALAM": "ml", "KANNADA": "kn",
}
_ALONE = ("", *sorted(set(SCRIPTS.values())))
UND = "und"

#: Labelled rows on which the scores are fitted, those with the smallest hash of their id.
TRAINING_ROWS = 5_000
#: Most characters of a text that is fitted on, and of all of them together.
TRAINING_TEXT, TRAINING_CHARS = 1 << 20, 64 << 20
#: Rows of the sample that must bear a label, the share of them that must be recognised, and by how much per word.
LEAST_ROWS, RECOGNISED, MARGIN = 8, 0.2, 0.1
#: Share of a language's words that are in a script it is written in, and that as a multiple of the script's share of all words.
SCRIPT_SHARE, SCRIPT_LIFT = 0.3, 0.9
#: Times the scores are fitted again to the paragraphs' own languages.
ROUNDS = 3
#: Least score of a word, relative to its best language.
FLOOR = -6.0
#: Cost of a switch of language between words, and where a paragraph starts.
SWITCH, SWITCH_AT_PARAGRAPH = 18.0, 9.0

_WORD = re.compile(r"[^\W\d_]+")


def label_codes(label: str | None) -> set[str]:
    """Languages that a label names by code (with or without a country) or English name."""
    words = re.split(r"[^A-Za-z_-]+", label or "")
    return {_NAMED[w] for x in words if (w := re.split(r"[-_]", x)[0].lower()) in _NAMED}


def folded(word: str) -> str:
    """A word without case and accents; Hangul stays composed."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c))
    return unicodedata.normalize("NFC", bare)


@functools.lru_cache(None)
def script_of(letter: str) -> str:
    """Script of a letter, as its Unicode name has it."""
    return unicodedata.name(letter, "").partition(" ")[0]


def _triples(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


@dataclass
class Model:
    """Scores per word and per letter triple; columns in order of ``codes``, of which the last is undetermined."""

    codes: tuple[str, ...]
    candidates: dict[str, tuple[int, ...]]
    words: dict[str, int]
    scores: np.ndarray
    triples: dict[str, np.ndarray]

    def score(self, word: str) -> np.ndarray:
        """Relative scores of a folded word, 0 for its best language."""
        own = self.candidates.get(script_of(word[0]), ())
        if len(own) < 2:
            s = np.full(len(self.codes), 4 * FLOOR)
            s[own[0] if own else -1] = 0.0
            return s
        if (i := self.words.get(word)) is not None:
            return self.scores[i]
        known = [t for x in _triples(word) if (t := self.triples.get(x)) is not None]
        if len(word) < 3 or not known:
            return np.zeros(len(self.codes))
        s = np.sum(known, axis=0) / 2
        return np.maximum(s - s.max(), FLOOR / 2)


def _relative(counts: np.ndarray, smoothing: float, foreign: np.ndarray) -> np.ndarray:
    """Log probabilities of the rows per language, relative to each row's best; ``foreign`` marks languages of other scripts."""
    s = np.log((counts + smoothing) / (counts.sum(axis=0) + 1.0 + smoothing * max(len(counts), 1)))
    best = np.where(foreign.all(axis=1), s.max(axis=1), s.max(axis=1, where=~foreign, initial=-np.inf))[:, None]
    s = np.where(foreign, np.minimum(s, best + FLOOR / 2), s)
    return np.maximum(s - s.max(axis=1, keepdims=True), FLOOR)


Sample = list[tuple[set[str], list[list[str]]]]


def _candidates(samples: Sample, codes: tuple[str, ...]) -> dict[str, tuple[int, ...]]:
    """Languages that each script may be of, by the scripts of the texts whose only label they are.

    Foreign words turn up in all texts, so a script must also be about as
    frequent in a language's texts as in all.
    """
    seen: dict[str, Counter] = {c: Counter() for c in codes}
    for labels, ps in samples:
        if len(labels) == 1 and (c := next(iter(labels))) in seen:
            seen[c].update(script_of(w[0]) for p in ps for w in p)
    every = sum(seen.values(), Counter())
    out: dict[str, list[int]] = defaultdict(list)
    for k, c in enumerate(codes):
        for script, n in seen[c].items():
            if script and n >= seen[c].total() * max(SCRIPT_SHARE, SCRIPT_LIFT * every[script] / every.total()):
                out[script].append(k)
    return {s: tuple(own) for s, own in out.items()}


class _Corpus:
    """Numbered words of scripts that several languages use."""

    def __init__(self, samples: Sample, codes: tuple[str, ...]):
        self.codes, self.candidates = codes, _candidates(samples, codes)
        number: dict[str, int] = {}
        start, paragraph, word, row = [], [], [], []
        for r, (labels, ps) in enumerate(samples):
            shared = {k for own in self.candidates.values() if len(own) > 1 for k in own}
            own = [k for k, c in enumerate(codes) if c in labels and k in shared]
            for p in ps:
                for w in p:
                    if len(self.candidates.get(script_of(w[0]), ())) > 1:
                        paragraph.append(len(start))
                        word.append(number.setdefault(w, len(number)))
                start.append(own[0] if len(own) == 1 else -1)
                row.append(r)
        self.start, self.row = np.array(start, int), np.array(row, int)
        self.at, self.ids, self.names = np.array(paragraph, int), np.array(word, int), list(number)
        self.foreign = self.foreign_of(self.names)

    def foreign_of(self, words: list[str]) -> np.ndarray:
        out = np.ones((len(words), len(self.codes) + 1), bool)
        for i, w in enumerate(words):
            out[i, list(self.candidates.get(script_of(w.strip()[:1] or " "), ()))] = False
        return out

    def counts(self, guess: np.ndarray) -> np.ndarray:
        lang = guess[self.at]
        return np.stack([np.bincount(self.ids[lang == k], minlength=len(self.names)) for k in range(len(self.codes) + 1)], axis=1).astype(float)

    def totals(self, scores: np.ndarray, per: np.ndarray, n: int) -> np.ndarray:
        """Summed scores of the words of each of ``n`` texts; only languages count."""
        return np.stack([np.bincount(per, scores[self.ids, k], n) for k in range(len(self.codes))], axis=1)


def _believed(samples: Sample) -> tuple[str, ...]:
    """Labels that stand for a language: enough texts that bear one are recognised by what other texts that bear it are like."""
    rows = Counter(next(iter(labels)) for labels, _ in samples if len(labels) == 1)
    codes = tuple(sorted(c for c, n in rows.items() if n >= LEAST_ROWS))
    corpus = _Corpus(samples, codes)
    labels = np.array([codes.index(c) if len(own) == 1 and (c := next(iter(own))) in codes else -1 for own, _ in samples], int)
    alone = {own[0] for own in corpus.candidates.values() if len(own) == 1} - {k for own in corpus.candidates.values() if len(own) > 1 for k in own}
    hits = np.zeros(len(codes))
    for half in (0, 1):
        guess = np.where(corpus.row % 2 == half, corpus.start, -1)
        if not len(corpus.ids):
            break
        total = corpus.totals(_relative(corpus.counts(guess), 0.2, corpus.foreign), corpus.row[corpus.at], len(samples))
        words = np.bincount(corpus.row[corpus.at], minlength=len(samples))
        shown = np.flatnonzero((labels >= 0) & (np.arange(len(samples)) % 2 != half) & (words > 0))
        own = total[shown, labels[shown]].copy()
        total[shown, labels[shown]] = -np.inf
        right = shown[own - total[shown].max(axis=1, initial=-np.inf) >= MARGIN * words[shown]]
        hits += np.bincount(labels[right], minlength=len(codes))
    return tuple(c for k, c in enumerate(codes) if k in alone or hits[k] >= RECOGNISED * rows[c])


def fit(samples: Sample) -> Model:
    """Fit to (languages of the label, paragraphs as folded words) by alternating counts and labels."""
    codes = _believed(samples)
    corpus = _Corpus(samples, codes)
    shown = (*codes, UND)
    if not len(corpus.ids):
        return Model(shown, corpus.candidates, {}, np.zeros((0, len(shown))), {})
    guess = corpus.start
    long = np.bincount(corpus.at, minlength=len(guess)) > 3
    for _ in range(ROUNDS + 1):
        counts = corpus.counts(guess)
        scores = _relative(counts, 0.2, corpus.foreign)
        total = corpus.totals(scores, corpus.at, len(guess))
        total[:, [k for k in range(len(codes)) if corpus.foreign[:, k].all()]] = -np.inf
        guess = np.where(long, total.argmax(axis=1), -1)
    triples: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(shown)))
    for i, name in enumerate(corpus.names):
        for t in _triples(name):
            triples[t] += np.minimum(counts[i], 5)  # kinds of words rather than words
    table = _relative(np.array(list(triples.values())), 1.0, corpus.foreign_of(list(triples)))
    return Model(shown, corpus.candidates, {w: n for n, w in enumerate(corpus.names)}, scores, dict(zip(triples, table)))


def viterbi(scores: np.ndarray, offsets: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Best language of every word. Texts lie one after the other; cost[i] is that of a switch before word i."""
    n, k = scores.shape
    out = np.zeros(n, np.int8)
    stay, top = np.zeros((n, k), bool), np.zeros(n, np.int8)  # back-pointers of every word
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    for lo in range(0, len(order), 1024):
        own = order[lo : lo + 1024]
        own = own[length[own] > 0]
        if not len(own):
            break
        first, size = offsets[:-1][own], length[own]
        best = scores[first].copy()
        live = len(own)
        for t in range(1, size[0]):
            while size[live - 1] <= t:
                live -= 1
            at = first[:live] + t
            b = best[:live]
            lead = b.argmax(axis=1)
            switch = b[np.arange(live), lead] - cost[at]
            keep = b >= switch[:, None]
            stay[at], top[at] = keep, lead
            best[:live] = np.where(keep, b, switch[:, None]) + scores[at]
        state = best.argmax(axis=1).astype(np.int8)
        for t in range(size[0] - 1, -1, -1):
            on = int(np.searchsorted(-size, -t, "left"))
            out[first[:on] + t] = state[:on]
            if t:
                s, at = state[:on], first[:on] + t
                state[:on] = np.where(stay[at, s], s, top[at])
    return out


#: Documents, or as many words, after which those read so far are analysed.
TOGETHER, WORDS_TOGETHER = 4_000, 1_500_000


class _Index:
    """Scores of the words seen so far in a task."""

    def __init__(self, model: Model):
        self.model, self.known, self.n = model, {}, 0
        self.table, self.alone = np.zeros((1024, len(model.codes)), np.float32), np.zeros(1024, np.int8)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the language that alone writes a word's script, as its place in _ALONE."""
        if self.n > 1_000_000:  # only a cache
            self.known, self.n = {}, 0
        known = self.known
        for w in set(words):
            if w not in known:
                if self.n == len(self.table):
                    self.table = np.vstack([self.table, np.zeros_like(self.table)])
                    self.alone = np.append(self.alone, np.zeros_like(self.alone))
                bare = folded(w) or w
                self.table[self.n] = self.model.score(bare)
                self.alone[self.n] = _ALONE.index(SCRIPTS.get(script_of(bare[0]), ""))
                known[w] = self.n
                self.n += 1
        rows = [known[w] for w in words]
        return self.table[rows], self.alone[rows]


_COLUMNS = ["doc_id", "paragraph", "n_sentences", "lang", "first_word", "n_words", "n_language_words", "n_paragraph_words", "confidence"]


def _analyse(model: Model):
    """Segments of a batch: one row per run of words of one paragraph in one language."""

    def run(batches):
        index = _Index(model)
        for batch in batches:
            held, n = [], 0
            for doc, text in zip(batch["doc_id"], batch["text"]):
                own = [(k, sentences(p), words) for k, p in enumerate(paragraphs(text) if text else ()) if (words := _WORD.findall(p))]
                if own:
                    held.append((doc, own))
                    n += sum(len(w) for _, _, w in own)
                if len(held) >= TOGETHER or n >= WORDS_TOGETHER:
                    yield labelled(index, held)
                    held, n = [], 0
            yield labelled(index, held)

    def labelled(index: _Index, docs: list) -> pd.DataFrame:
        if not docs:
            return pd.DataFrame(columns=_COLUMNS)
        place = [(d, k, s, len(w)) for d, (_, own) in enumerate(docs) for k, s, w in own]
        where = np.array(place)
        counts = where[:, 3]
        scores, alone = index.of([x for _, own in docs for _, _, w in own for x in w])
        codes = model.codes
        starts = np.append(0, np.cumsum(counts))
        cost = np.full(len(scores), SWITCH, np.float32)
        cost[starts[:-1]] = SWITCH_AT_PARAGRAPH
        sizes = np.bincount(where[:, 0], counts, len(docs)).astype(np.int64)
        state = viterbi(scores, np.append(0, np.cumsum(sizes)), cost)
        each = np.repeat(np.arange(len(counts)), counts) * len(codes) + state
        change = np.append(True, each[1:] != each[:-1])
        first, inverse = np.flatnonzero(change), np.cumsum(change) - 1
        key = each[first]
        total = np.stack([np.bincount(inverse, scores[:, k], len(key)) for k in range(len(codes))], axis=1)
        lang, place_of = key % len(codes), key // len(codes)
        names = np.array(codes, dtype=object)[lang]
        open_ = np.flatnonzero(lang == len(codes) - 1)
        if len(open_):  # undetermined spans may be in a script of one language
            written = np.bincount(inverse * len(_ALONE) + alone, minlength=len(key) * len(_ALONE)).reshape(len(key), -1)[open_]
            most = written[:, 1:].argmax(axis=1) + 1
            sure = 2 * written[np.arange(len(open_)), most] > written.sum(axis=1)
            names[open_[sure]] = np.array(_ALONE, dtype=object)[most[sure]]
        at, n = where[place_of], np.bincount(inverse)
        _, same = np.unique(key, return_inverse=True)
        together = np.bincount(same, n).astype(np.int64)[same]
        rival = total - total[np.arange(len(key)), lang][:, None]
        confidence = 1 / np.exp(np.minimum(rival, 50)).sum(axis=1)
        ids = np.array([d for d, _ in docs])
        columns = (ids[at[:, 0]], at[:, 1], at[:, 2], names, first - starts[place_of], n, together, at[:, 3], confidence)
        return pd.DataFrame(dict(zip(_COLUMNS, columns)))

    return run


_LABEL = r"(?i)^\s*(" + "|".join(sorted(_NAMED)) + r")([-_][a-z]{2})?\s*$"


def train(docs: DataFrame, *, rows: int = TRAINING_ROWS) -> Model:
    """Fit on at most ``rows`` documents whose label names one language, those with the smallest hash of their id.

    Texts of more than ``TRAINING_TEXT`` characters are not fitted on, and of the
    others at most ``TRAINING_CHARS`` characters in all.
    """
    labelled = docs.where(F.col("label").rlike(_LABEL) & F.col("text").isNotNull() & (F.length("text") <= TRAINING_TEXT)).withColumn("h", F.xxhash64("doc_id"))
    smallest = labelled.select("h", F.length("text")).orderBy("h").limit(rows).collect()
    kept = [h for (h, _), all_of in zip(smallest, itertools.accumulate(n for _, n in smallest)) if all_of <= TRAINING_CHARS]
    if not kept:
        return fit([])
    sample = labelled.where(F.col("h") <= kept[-1]).select("label", "text").limit(len(kept)).mapInPandas(_folded_paragraphs, "label string, words string")
    return fit([(label_codes(r[0]), [p.split(" ") for p in r[1].split("\n") if p]) for r in sample.collect()])


def _folded_paragraphs(batches):
    """Words of each text's paragraphs, one line a paragraph."""
    for batch in batches:
        lines = ["\n".join(" ".join(folded(w) or w for w in _WORD.findall(p)) for p in paragraphs(x)) for x in batch["text"]]
        yield pd.DataFrame({"label": batch["label"], "words": lines})


def segments(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: Model | None = None) -> DataFrame:
    """(doc_id, paragraph, n_sentences, lang, first_word, n_words, n_language_words, n_paragraph_words, confidence): the spans of each paragraph of each body.

    A span ends where the language or the paragraph changes; ``first_word`` is
    its first word's number in the paragraph, from 0. ``n_language_words`` are
    the words of all spans of the paragraph in its language. ``confidence`` is
    the share of the span's language among all languages, by the words of the
    span.

    Defined cases: null, empty and blank texts and bodies without prose have no
    segments; a null label, or one that names no language, only means that the
    row isn't used for fitting; words of scripts that no believed label's texts
    use are ``und`` or of the language that alone writes the script; repeated rows are analysed each; an empty table gives
    an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    model = model or train(docs)
    schema = "doc_id long, paragraph int, n_sentences int, lang string, first_word int, n_words int, n_language_words int, n_paragraph_words int, confidence double"
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(_analyse(model), schema)


def names(label: Column) -> Column:
    """Languages that a label names, as an array of two-letter codes."""
    words = F.transform(F.split(F.coalesce(label, F.lit("")), "[^A-Za-z_-]+"), lambda w: F.lower(F.regexp_extract(w, "^[A-Za-z]*", 0)))
    codes = F.create_map(*[F.lit(x) for pair in sorted(_NAMED.items()) for x in pair])
    return F.array_compact(F.transform(words, lambda w: F.try_element_at(codes, w)))


def document_languages(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang, confidence): the language of most words of every document, ties by code.

    ``confidence`` is the share of the document's words in that language times
    the spans' mean confidence; documents without prose are ``und`` with 0.
    """
    per = found.groupBy("doc_id", "lang").agg(F.sum("n_words").alias("n"), F.sum(F.col("n_words") * F.col("confidence")).alias("c"))
    per = per.groupBy("doc_id").agg(F.max(F.struct("n", F.expr("-ascii(lang) * 256 - ascii(substring(lang, 2))").alias("k"), "lang", "c")).alias("m"), F.sum("n").alias("all"))
    best = per.select("doc_id", F.col("m.lang").alias("lang"), (F.col("m.c") / F.col("all")).alias("confidence"))
    ids = docs.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct()
    return ids.join(best, "doc_id", "left").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def unnamed_languages(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", label_col: str = "lang") -> DataFrame:
    """(doc_id, lang): languages of a paragraph of two or more sentences that the label doesn't name; ``und`` is none."""
    written = found.where((F.col("lang") != UND) & (F.col("n_sentences") >= 2) & (2 * F.col("n_language_words") > F.col("n_paragraph_words"))).select("doc_id", "lang").distinct()
    labels = docs.select(F.col(id_col).alias("doc_id"), names(F.col(label_col)).alias("named"))
    return written.join(labels, "doc_id").where(~F.array_contains("named", F.col("lang"))).select("doc_id", "lang").distinct()
