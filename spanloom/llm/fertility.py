"""Quality rules: tokeniser fertility by public vocabulary, with bands per language or script.

A public vocabulary with byte fallback cuts each distinct word once per task (its merges
never cross white space, so a text's tokens are its words' tokens). Over the whole text
come characters per token, the share of byte-fallback tokens and the token entropy in
bits. A text is rejected outside its language's band, or its script's where the language
has none. Plain counts of words, symbols, repeated lines and repeated three-word windows
stand beside them, with a floor on words and a ceiling on repetition.

Defined results: null, empty and white-space texts have zero counts, null measures, and
fail by the floor on words; a null language falls to the script; repeated rows get equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import Flat

#: Least and most characters per token, most byte-fallback share, least entropy in bits, script. Fitted
#: to `piece_bpe_32k` by language: least characters 3 to 6% under the least of 8,884 clean texts (1.80 en,
#: 1.77 de, 1.65 fr, 1.76 es; random letters have 1.41 to 1.61), least entropy 5% under theirs (5.16 to
#: 5.42); no more characters than half as many again as plain prose (4.5 en, 3.4 de, 2.9 fr, 2.8 es).
#: A language that is known is held to its own band and script whatever the text is written in.
LANGUAGE_BANDS = {
    "en": (1.70, 6.8, 0.05, 4.9, "latin"),
    "de": (1.68, 5.4, 0.05, 4.9, "latin"),
    "fr": (1.60, 4.8, 0.05, 4.9, "latin"),
    "es": (1.65, 4.8, 0.05, 4.9, "latin"),
}
SCRIPT_BANDS = {
    "latin": (1.2, 9.0, 0.15, 4.4),
    "greek": (0.6, 6.0, 0.60, 4.0),
    "cyrillic": (0.8, 8.0, 0.40, 4.2),
    "cjk": (0.25, 4.0, 0.90, 4.0),
    "other": (0.25, 9.0, 0.95, 3.6),
}
#: Texts of fewer tokens reach less entropy; below this count the bound shrinks as log2 of the count.
FULL_ENTROPY_TOKENS = 256
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Distinct words a task remembers; beyond it, it forgets all and goes on (bounds memory only).
REMEMBERED = 150_000

_class = np.zeros(256, np.uint8)  # 0 first byte of a character, 1 a further byte, 2 white space, 3 symbol, 4-7 first bytes of other scripts
_class[0x80:0xC0] = 1
_class[[0x20, *range(0x09, 0x0E)]] = 2
_class[list(SYMBOLS)] = 3
_class[[0xCD, 0xCE, 0xCF]] = 4  # Greek
_class[0xD0:0xD4] = 5  # Cyrillic
_class[0xE3:0xEE] = 6  # CJK, kana, Hangul
_class[[*range(0xD4, 0xE3), *range(0xEE, 0xF8)]] = 7
SCRIPTS = ("latin", "greek", "cyrillic", "cjk", "other")


class Fertility:
    def __init__(self, model: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.forget()

    def forget(self) -> None:
        self.new: list[bytes] = []
        new = self.new

        class Known(dict):
            def __missing__(self, word):
                new.append(word)
                self[word] = at = len(self)
                return at

        self.known, self.pieces = Known(), Flat(np.int32)

    def measure(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.forget()
        words = [t.split() for t in texts]  # bytes split at ASCII white space alone
        index = [np.fromiter(map(self.known.__getitem__, w), np.int64, len(w)) for w in words]
        if self.new:
            ids = self.model.encode([w.decode() for w in self.new], num_threads=1)
            self.pieces.extend(np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64))
            self.new.clear()
        n_words = np.array([len(w) for w in words], np.int64)
        ids, lengths = self.pieces.take(np.concatenate(index))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        n_tokens = np.diff(ends[np.concatenate([[0], np.cumsum(n_words)])])
        doc = np.repeat(np.arange(len(texts)), n_tokens)
        n_bytes = np.bincount(doc, self.is_byte[ids], minlength=len(texts)).astype(np.int64)
        keys = np.sort(doc * self.size + ids)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(keys)))
        of = keys[first] // self.size
        entropy = np.log2(np.maximum(n_tokens, 1)) - np.bincount(of, counts * np.log2(np.maximum(counts, 1)), minlength=len(texts)) / np.maximum(n_tokens, 1)
        out = {"n_words": n_words, "n_tokens": n_tokens, "n_byte_tokens": n_bytes, "entropy": np.where(n_tokens > 0, entropy, 0.0)}
        classes = np.array([np.bincount(_class[np.frombuffer(t, np.uint8)], minlength=8) for t in texts])
        out["word_chars"] = classes.sum(1) - classes[:, 1] - classes[:, 2]
        out["n_symbols"] = classes[:, 3]
        scripts = np.stack([classes[:, 0], *(classes[:, 4:8].T)], 1)
        out["script"] = scripts.argmax(1)
        out["n_dup_lines"] = np.array([dup_lines(t) for t in texts], np.int64)
        out["n_repeat_words"] = np.array([repeat_words(i) for i in index], np.int64)
        return out


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip(b"\x20\t\n\v\f\r")]
    return len(lines) - len(set(lines))


def repeat_words(ids: np.ndarray) -> int:
    """Words in three-word windows that are found twice or more."""
    if len(ids) < 4:
        return 0
    if ids.max() < 1 << 21:
        keys = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:  # number the pairs first
        keys = np.unique(ids[:-2] << 32 | ids[1:-1], return_inverse=True)[1] << 32 | ids[2:]
    ordered = np.sort(keys)
    if not (twice := ordered[1:] == ordered[:-1]).any():
        return 0
    hit = np.isin(keys, ordered[1:][twice])
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= hit
    return int(covered.sum())


_models: dict[str, Fertility] = {}


def fertility(model: str) -> Fertility:
    """One model for each Python worker."""
    if model not in _models:
        _models[model] = Fertility(model)
    return _models[model]


MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, n_byte_tokens bigint, entropy double, script string"


def measures(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """id, lang and the measures of every whole text; map-only."""
    kinds = dict(docs.dtypes)

    def run(batches):
        own = fertility(model)
        for rows in common.slices(batches, text_column):
            m = own.measure(common.texts_of(rows, text_column))
            m["script"] = np.array(SCRIPTS)[m["script"]]
            names = [x.split()[0] for x in MEASURES.split(", ")]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), *(pa.array(m[n]) for n in names)], [id_column, lang_column, *names])
        own.forget()
        common.release()

    return docs.select(id_column, text_column, lang_column).mapInArrow(run, f"`{id_column}` {kinds[id_column]}, `{lang_column}` {kinds[lang_column]}, {MEASURES}")


def verdict(lang: str, language_bands=None, script_bands=None):
    """Columns base_failed and kept over the measures."""
    languages, scripts = language_bands or LANGUAGE_BANDS, script_bands or SCRIPT_BANDS
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))

    def inside(band):
        least, most, bytes_most, bits = band[:4]
        per_token = F.col("word_chars") / F.col("n_tokens")
        scale = F.least(F.lit(1.0), F.log2(F.greatest(F.col("n_tokens"), F.lit(2))) / float(np.log2(FULL_ENTROPY_TOKENS)))
        return per_token.between(least, most) & (F.col("n_byte_tokens") <= bytes_most * F.col("n_tokens")) & (F.col("entropy") >= bits * scale)

    fits = F.lit(False)
    for name, band in scripts.items():
        fits = F.when(F.col("script") == name, inside(band)).otherwise(fits)
    for name, band in languages.items():
        fits = F.when(F.col(lang).eqNullSafe(name), inside(band) & (F.col("script") == band[4])).otherwise(fits)
    return base_failed, ~base_failed & (F.col("n_tokens") > 0) & F.coalesce(fits, F.lit(False))


def judge(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """One row for each document: counts, base_failed, kept, and the fertility measures."""
    base_failed, kept = verdict(lang_column)
    some = F.col("n_tokens") > 0
    return measures(docs, model, id_column, text_column, lang_column).select(
        id_column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), kept.alias("kept"), "n_tokens",
        F.when(some, F.col("word_chars") / F.col("n_tokens")).alias("chars_per_token"), F.when(some, F.col("n_byte_tokens") / F.col("n_tokens")).alias("byte_share"), F.when(some, F.col("entropy")).alias("token_entropy"), "script",
    )


def filtered(docs: DataFrame, model: str, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows that the rules keep, all columns; the verdict is computed beside each text, without a join."""
    given, names, schema = common.by_place(docs)
    text, lang = (names[docs.columns.index(c)] for c in (text_column, lang_column))
    measured = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches):
        own = fertility(model)
        for rows in common.slices(batches, text, 2 << 20):
            m = own.measure(common.texts_of(rows, text))
            m["script"] = np.array(SCRIPTS)[m["script"]]
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(m[n]) for n in measured)], [*names, *measured])
        own.forget()
        common.release()

    _, kept = verdict(lang)
    return given.mapInArrow(run, f"{schema}, {MEASURES}").filter(kept).select(*names).toDF(*docs.columns)
