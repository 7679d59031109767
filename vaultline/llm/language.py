"""Language identification by words first, then ever shorter character n-grams (operator 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import fold_of, map_arrow, packed, table, unpacked

#: A run of letters is a word; of a longer one every LONGEST letters are.
LONGEST = 64
LETTERS = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")
UNKNOWN = "und"
#: Lengths of the n-grams that an unseen word falls back to, longest first. Words are framed as ^word$ for them.
ORDERS = (5, 4, 3, 2, 1)
#: Entries of a worker's memory of words.
MEMORY = 100_000


@dataclass
class LanguageModel:
    """Log frequencies per language: rows of `table`, aligned with langs, that words and grams name by number.

    floor is for words of which nothing is known.
    """

    langs: list[str]
    prior: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    floor: np.ndarray

    def of_word(self, word: str) -> np.ndarray:
        """Log scores of one word: its own frequency if known, else the mean over its longest known n-grams."""
        return self.backed(word)[0]

    def backed(self, word: str) -> tuple[np.ndarray, bool]:
        """of_word(), and whether the word is known or has a known n-gram of three letters or more, `^` and `$` included."""
        if (own := self.words.get(word)) is not None:
            return self.table[own], True
        framed = f"^{word}$"
        for n in ORDERS:
            found = [g for i in range(len(framed) - n + 1) if (g := self.grams.get(framed[i : i + n])) is not None]
            if found:
                return self.table[found].mean(axis=0), n >= 3
        return self.floor, False


def fit(docs: DataFrame, docs_per_language: int = 2500, least: int = 3) -> LanguageModel:
    """Fit on rows with text and lang.

    The sample is bounded: about docs_per_language documents of each language, by a hash of doc_id, whole texts. The model
    holds all words and n-grams that stand in it `least` times or more; rarer ones say little of a language. So the sample bounds
    the model, and what the driver gets. Nothing but text and lang is learned from; rows that repeat, or share an id
    with different languages, count as rows; a table without labelled text gives a model without languages.
    """
    labelled = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    total = sum(counts.values())
    if not langs:
        return LanguageModel([], np.zeros(0), {}, {}, np.zeros((0, 0)), np.zeros(0))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(1e6 * min(1, docs_per_language / counts[k])) + 1))])
    sample = labelled.where(part < share[F.col("lang")])
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"(\p{{L}}{{1,{LONGEST}}})"), 1)).alias("word")
    per_word = sample.select("lang", word).groupBy("lang", "word").agg(F.count("*").alias("n")).persist()
    try:
        framed = F.concat(F.lit("^"), "word", F.lit("$"))

        def of_length(n: int):
            cut = F.transform(F.sequence(F.lit(1), F.length(framed) - n + 1), lambda i: F.substring(framed, i, F.lit(n)))
            return F.when(F.length(framed) >= n, cut).otherwise(F.array().cast("array<string>"))

        grams = F.flatten(F.array(*[of_length(n) for n in ORDERS]))
        per_gram = per_word.select("lang", "n", F.explode(grams).alias("word"))
        per_gram = per_gram.groupBy("lang", "word").agg(F.sum("n").alias("n"))
        words = _frequent(per_word, langs, least)
        grams_found = _frequent(per_gram, langs, least)
        sums = {r.lang: r.n for r in per_word.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    finally:
        per_word.unpersist()
    mass = np.array([sums.get(k, 0) for k in langs], float)
    prior = np.log(np.array([counts[k] for k in langs], float) / total)
    gram_mass = {k: np.zeros(len(langs)) for k in ORDERS}
    for g, n in grams_found:
        gram_mass[len(g)] += n
    rows = [np.log((n + 0.5) / (mass + 1)) for _, n in words] + [np.log((n + 0.5) / (gram_mass[len(g)] + 1)) for g, n in grams_found]
    numbers = {w: i for i, (w, _) in enumerate(words)}, {g: len(words) + i for i, (g, _) in enumerate(grams_found)}
    floor = np.full(len(langs), np.log(0.5 / (mass + 1)).min())
    return LanguageModel(langs, prior, *numbers, np.array(rows).reshape(-1, len(langs)), floor)


def _frequent(counts: DataFrame, langs: list[str], least: int) -> list[tuple[str, np.ndarray]]:
    """Keys that occur `least` times or more, with their counts per language, in byte order."""
    own = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{i}") for i, k in enumerate(langs)]
    rows = counts.groupBy("word").agg(F.sum("n").alias("n"), *own).where(F.col("n") >= least)
    return sorted(((r[0], np.array(r[2:], float)) for r in rows.collect()), key=lambda x: x[0])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`docs` with lang_pred, score (the posterior of lang_pred) and backed (the share of words that are known, or have a known
    n-gram of three letters or more), replacing columns of these names.

    Only text is looked at, all of it, however long. Null texts, texts without a letter, and any text under a model without languages
    get `und` and 0, 0. Ties go to the language first in order. Other columns and repeated rows pass through.
    """
    from .bpe import ddl

    kept = docs.drop("lang_pred", "score", "backed")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = shared.value, {}
        matrix = np.zeros((1024, len(model.langs) + 1))  # the last column: whether the word is backed
        for whole in batches:
            for b in slices(whole, "text", 1_000_000):
                langs, scores, backed = [], [], []
                if len(memory) > MEMORY:
                    memory.clear()
                found = [LETTERS.findall(t.lower()) if t else [] for t in b.column("text").to_pylist()]
                new = set().union(*found).difference(memory)
                if len(memory) + len(new) > len(matrix):
                    matrix = np.concatenate([matrix, np.zeros((len(matrix) + len(new), matrix.shape[1]))])
                for w in new:
                    matrix[len(memory), :-1], matrix[len(memory), -1] = model.backed(w)
                    memory[w] = len(memory)
                for words in found:
                    if not model.langs or not any(c.isalpha() for w in words for c in w):  # numerals like ² are no letters
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        backed.append(0.0)
                        continue
                    at = np.fromiter(map(memory.__getitem__, words), np.int64, len(words))
                    sums = matrix[at].sum(axis=0)
                    z = sums[:-1] + model.prior
                    backed.append(float(sums[-1] / len(words)))
                    k = int(np.argmax(z))
                    langs.append(model.langs[k])
                    scores.append(float(1 / np.exp(np.clip(z - z[k], -700, 0)).sum()))
                del found
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(backed, pa.float64())], [*b.schema.names, "lang_pred", "score", "backed"])

    return map_arrow(kept, run, f"{ddl(kept)}, lang_pred string, score double, backed double")


def is_held_out():
    return F.coalesce(fold_of() == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents that aren't held out, predict all: doc_id, held_out, lang_pred, score.

    A null doc_id counts as not held out. An empty table gives an empty result.
    """
    model = fit(docs.where(~is_held_out()))
    held = docs.select(F.col("doc_id").cast("long"), "text", is_held_out().alias("held_out"))
    return predict(held, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, backing: float = 0.5) -> DataFrame:
    """The rows whose language is recognised: neither `und`, nor a best posterior under `least`, nor under `backing` of the words
    known or made of known n-grams, as in a script or language that was not learned. Columns stay as they are."""
    model = fit(docs.where(~is_held_out()))
    kept = predict(packed(docs, "text"), model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least) & (F.col("backed") >= backing))
    return unpacked(kept.drop("lang_pred", "score", "backed"), docs)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
