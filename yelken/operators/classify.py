"""Weighted keyword classification: one Aho-Corasick pass a text finds all keywords, built-in expressions decide."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yelken.functions.text import matching_text
from yelken.lexicon import KEYWORDS, PRIORITY

MIN_SCORE, ANCHOR_WEIGHT, CLOSE_RATIO, TITLE_WEIGHT, MAX_HITS = 4, 3, 0.6, 2, 3
MOST_KEYWORDS = 100_000  # rows of a keyword table that every task is handed


def keyword_rows(keywords: DataFrame | None = None) -> list[tuple[str, str, int, int]]:
    """(category, keyword, weight, position within its category) of the fixed table, or of a DataFrame (category, keyword, weight) of at most
    MOST_KEYWORDS rows, taken in order of category, falling weight and keyword."""
    rows = KEYWORDS
    if keywords is not None:
        rows = [tuple(r) for r in keywords.select("category", "keyword", "weight").orderBy("category", F.desc("weight"), "keyword").limit(MOST_KEYWORDS + 1).collect()]
        if len(rows) > MOST_KEYWORDS:
            raise ValueError(f"more than {MOST_KEYWORDS} keywords")
    at: dict[str, int] = {}
    out = []
    for category, word, weight in rows:
        out.append((category, word, weight, at.get(category, 0)))
        at[category] = at.get(category, 0) + 1
    return out


def _finder(rows: list[tuple[str, str, int, int]]):
    """A function from a batch of (title, content) to the hits of each: [(row of the table, hits in title, hits in content)]."""
    import ahocorasick

    forms: dict[str, list[int]] = {}
    for i, (_, word, _, _) in enumerate(rows):
        forms.setdefault(f" {word[:-1]} " if word.endswith("$") else f" {word}", []).append(i)
    machine = ahocorasick.Automaton()
    for form, ids in forms.items():
        machine.add_word(form, (len(form) - (2 if form.endswith(" ") else 1), form.endswith(" "), ids))
    if forms:
        machine.make_automaton()

    def count(text: str) -> dict[int, int]:
        free: dict[int, int] = {}
        n: dict[int, int] = {}
        for end, (size, whole, ids) in machine.iter(f" {text} ") if forms else ():
            last = end - 1 if whole else end
            if last - size + 1 >= free.get(ids[0], 0):
                free[ids[0]] = last + 1
                for i in ids:
                    n[i] = n.get(i, 0) + 1
        return n

    def hits(title: str | None, content: str | None) -> list[tuple[int, int, int]]:
        t, c = count(matching_text(title)), count(matching_text(content))
        return [(i, min(t.get(i, 0), MAX_HITS), min(c.get(i, 0), MAX_HITS)) for i in sorted({*t, *c})]

    return hits


def with_hits(df: DataFrame, title: str, content: str, keywords: DataFrame | None = None) -> DataFrame:
    """``df`` with __hits ARRAY<STRUCT<category, keyword, weight, ord, in_title, in_content>>: the keywords found, hits not overlapping, at most MAX_HITS a
    field. One Arrow pass a text; nothing is exploded or shuffled."""
    rows = keyword_rows(keywords)

    @F.pandas_udf("array<struct<i: int, t: int, c: int>>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hits = _finder(rows)
        for titles, contents in batches:
            yield pd.Series([[{"i": i, "t": t, "c": c} for i, t, c in hits(a, b)] for a, b in zip(titles, contents)], dtype=object)

    known = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(w.rstrip("$")).alias("keyword"), F.lit(n).alias("weight"), F.lit(k).alias("ord")) for c, w, n, k in rows])
    full = F.transform("__found", lambda h: F.struct(F.get(known, h["i"]).alias("k"), h["t"].alias("t"), h["c"].alias("c")))
    flat = F.transform(full, lambda h: F.struct(h["k"]["category"].alias("category"), h["k"]["keyword"].alias("keyword"), h["k"]["weight"].alias("weight"), h["k"]["ord"].alias("ord"), h["t"].alias("in_title"), h["c"].alias("in_content")))
    return df.withColumn("__found", find(F.col(title), F.col(content))).withColumn("__hits", flat).drop("__found")


def keyword_hits(df: DataFrame, key: str, title: str, content: str, keywords: DataFrame | None = None) -> DataFrame:
    """(key, category, keyword, weight, in_title, hits): hits of each keyword per field, not overlapping, at most MAX_HITS."""
    found = with_hits(df.select(F.col(key).alias("__key"), F.col(title).alias("__t"), F.col(content).alias("__c")), "__t", "__c", keywords).select("__key", F.explode("__hits").alias("h"))
    fields = F.array(F.struct(F.lit(True).alias("in_title"), F.col("h.in_title").alias("hits")), F.struct(F.lit(False).alias("in_title"), F.col("h.in_content").alias("hits")))
    each = found.select("__key", "h.category", "h.keyword", "h.weight", F.explode(F.filter(fields, lambda f: f["hits"] > 0)).alias("f"))
    return each.select(F.col("__key").alias(key), "category", "keyword", "weight", "f.in_title", "f.hits")


def _points(h: Column) -> Column:
    return h["weight"] * (h["in_title"] * TITLE_WEIGHT + h["in_content"])


def _scores(hits: Column, category: str) -> Column:
    """STRUCT<category, score, anchored, n> of one category."""
    own = F.filter(hits, lambda h: h["category"] == category)
    return F.struct(F.lit(category).alias("category"), F.aggregate(own, F.lit(0), lambda s, h: s + _points(h)).alias("score"), F.exists(own, lambda h: h["weight"] >= ANCHOR_WEIGHT).alias("anchored"), F.size(own).alias("n"))


def category_scores(df: DataFrame, key: str, title: str, content: str, keywords: DataFrame | None = None) -> DataFrame:
    """(key, category, score, anchored) of the categories with any hit."""
    categories = list(dict.fromkeys(r[0] for r in keyword_rows(keywords)))
    found = with_hits(df.select(F.col(key).alias("__key"), F.col(title).alias("__t"), F.col(content).alias("__c")), "__t", "__c", keywords)
    each = found.select("__key", F.explode(F.filter(F.array(*[_scores(F.col("__hits"), c) for c in categories]), lambda s: s["n"] > 0)).alias("s"))
    return each.select(F.col("__key").alias(key), "s.category", F.col("s.score").cast("bigint").alias("score"), "s.anchored")


def explain(df: DataFrame, key: str, title: str, content: str, keywords: DataFrame | None = None, priority: dict[str, int] | None = None) -> DataFrame:
    """(key, category, score, n_candidates, scores, matched) of every distinct key. The category is NULL without an anchored score of MIN_SCORE; among those
    within CLOSE_RATIO of the best the one first in priority is chosen. scores ARRAY<STRUCT<category, score>> holds every category; matched
    ARRAY<STRUCT<category, keywords>> those with hits, keywords of the title before those of the content, in order of the table, each once. NULL
    texts count as empty; of several rows of a key one is taken. All in the row: one shuffle drops repeated keys, nothing else moves."""
    rank = PRIORITY if priority is None else priority
    categories = list(dict.fromkeys(r[0] for r in keyword_rows(keywords)))
    one = df.select(F.col(key).alias("__key"), F.col(title).alias("__t"), F.col(content).alias("__c")).dropDuplicates(["__key"])
    found = with_hits(one, "__t", "__c", keywords).drop("__t", "__c").withColumn("__s", F.array(*[_scores(F.col("__hits"), c) for c in categories]))
    fit = F.filter("__s", lambda s: s["anchored"] & (s["score"] >= MIN_SCORE))
    found = found.withColumn("__fit", fit).withColumn("__top", F.array_max(F.transform("__fit", lambda s: s["score"])))
    ranks = F.create_map(*[F.lit(x) for c in categories for x in (c, rank.get(c, len(rank) + 1))])
    close = F.array_sort(F.transform(F.filter("__fit", lambda s: s["score"] >= F.col("__top") * CLOSE_RATIO), lambda s: F.struct(F.element_at(ranks, s["category"]).alias("rank"), s["category"].alias("category"), s["score"].alias("score"))))
    found = found.withColumn("__close", close)

    def words(category: str) -> Column:
        own = F.filter("__hits", lambda h: h["category"] == category)
        named = lambda field: F.transform(F.array_sort(F.transform(F.filter(own, lambda h: h[field] > 0), lambda h: F.struct(h["ord"].alias("ord"), h["keyword"].alias("keyword")))), lambda x: x["keyword"])
        return F.struct(F.lit(category).alias("category"), F.array_distinct(F.concat(named("in_title"), named("in_content"))).alias("keywords"))

    first = F.get("__close", F.lit(0))
    return found.select(
        F.col("__key").alias(key), first["category"].alias("category"), first["score"].cast("bigint").alias("score"), F.when(F.size("__close") > 0, F.size("__close")).alias("n_candidates"),
        F.transform("__s", lambda s: F.struct(s["category"].alias("category"), s["score"].alias("score"))).alias("scores"), F.filter(F.array(*[words(c) for c in categories]), lambda x: F.size(x["keywords"]) > 0).alias("matched"),
    )


def classify(df: DataFrame, key: str, title: str, content: str, keywords: DataFrame | None = None) -> DataFrame:
    """(key, category, score, n_candidates) of every distinct key, see explain."""
    return explain(df, key, title, content, keywords).select(key, "category", "score", "n_candidates")
