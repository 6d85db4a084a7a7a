"""Full-text search: an inverted index as DataFrames and BM25 with column weights."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Weights of a node's indexed columns.
NODE_WEIGHTS = {"name": 10.0, "tokens": 6.0, "signature": 3.0, "doc": 2.0, "path": 0.5}
TOKEN = r"[\p{L}\p{N}]+"
MARKS = r"\p{M}+"
#: Letters with marks and the letters without, by canonical decomposition.
MARKED = {chr(c): b for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if (d := unicodedata.normalize("NFD", chr(c))) and len(d) > 1 and len(b := "".join(x for x in d if not unicodedata.combining(x))) == 1}


def tokens_of(column: str):
    """Lower-cased runs of letters and digits without marks, in order."""
    plain = F.translate(F.lower(F.coalesce(F.col(column), F.lit(""))), "".join(MARKED), "".join(MARKED.values()))
    return F.regexp_extract_all(F.regexp_replace(plain, MARKS, ""), F.lit(TOKEN), F.lit(0))


def postings(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, col, term, tf) of every term."""
    cols = F.array(*(F.struct(F.lit(c).alias("col"), tokens_of(c).alias("terms")) for c in columns))
    flat = rows.select(F.col(id_col).alias("id"), F.explode(cols).alias("c")).select("id", "c.col", F.explode("c.terms").alias("term"))
    return flat.groupBy("id", "col", "term").agg(F.count("*").alias("tf"))


def terms_of_query(query: str) -> list[list[str]]:
    """A phrase (list of terms) for each word of the query; each phrase once."""
    found: list[list[str]] = []
    for word in query.replace('"', " ").split():
        plain = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
        phrase = re.findall(r"[^\W_]+", plain)
        if phrase and phrase not in found:
            found.append(phrase)
    return found


def bm25(rows: DataFrame, id_col: str, weights: dict[str, float], query: str, limit: int) -> DataFrame:
    """The ``limit`` rows that match any phrase of ``query`` best: id, score; ties to the smaller id.

    One pass over the rows counts phrases and lengths in place, so only matching rows are carried on; document counts and the mean length
    are one-row aggregates.
    """
    phrases = terms_of_query(query)
    arrays = {c: tokens_of(c) for c in weights}
    sized = rows.select(F.col(id_col).alias("id"), *(arrays[c].alias(f"t_{c}") for c in weights))
    length = sum((F.size(f"t_{c}") for c in weights), F.lit(0))

    def tf(column: str, phrase: list[str]):
        t = F.col(f"t_{column}")
        if len(phrase) == 1:
            return F.size(F.filter(t, lambda x: x == phrase[0]))
        at = F.sequence(F.lit(0), F.greatest(F.size(t) - len(phrase), F.lit(0)))
        hit = lambda i: F.forall(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(phrase))), lambda x: F.coalesce(F.get(t, i + x["k"]) == x["p"], F.lit(False)))
        return F.size(F.filter(at, hit))

    if not phrases:
        return sized.select("id", F.lit(0.0).alias("score")).limit(0)
    per = [sum((F.lit(float(w)) * tf(c, p) for c, w in weights.items()), F.lit(0.0)).alias(f"f{k}") for k, p in enumerate(phrases)]
    counted = sized.select("id", length.alias("dl"), *per)
    stats = counted.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(phrases))))

    def part(k: int):
        n, f = F.col(f"n{k}"), F.col(f"f{k}")
        idf = F.log((F.col("n_docs") - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
        return F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(F.lit(0.0))

    hits = counted.where(" or ".join(f"f{k} > 0" for k in range(len(phrases))))
    scored = hits.crossJoin(F.broadcast(stats)).select("id", sum((part(k) for k in range(1, len(phrases))), part(0)).alias("score"))  # stats is one row
    return scored.orderBy(F.desc("score"), "id").limit(limit)
