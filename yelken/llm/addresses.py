"""Same postal address written differently (problem 5): probabilistic record linkage.

Addresses are parsed into components; words are put right against the corpus' own vocabulary (a rare word one edit from a
much more frequent one, found through shared deletions, not by comparing all words). Distinct parsed forms, not rows, are then
blocked on house number with street-sound keys or the postcode and compared component by component. The comparison patterns, of
which there is a fixed number, are counted and Fellegi-Sunter weights estimated by expectation-maximization, with levels of their
own for missing values and for slips; what agrees by chance is counted over all forms. The weights decide; contradictions (number, letter, kind, district) never meet.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yelken.llm.plain import folded
from yelken.session import stored, table

# Folded words that mark the components of a Turkish address.
STREET_KINDS = {
    "sokak": "sokak", "sokagi": "sokak", "sok": "sokak", "sk": "sokak", "cadde": "cadde", "caddesi": "cadde", "cad": "cadde", "cd": "cadde",
    "bulvar": "bulvar", "bulvari": "bulvar", "bulv": "bulvar", "blv": "bulvar", "bul": "bulvar",
}
QUARTER_MARKS = {"mahallesi", "mahalle", "mah", "mh"}
NUMBER_MARKS = {"no", "numara", "n", "nr", "num"}
LANDMARK_ENDS = {"karsisi", "yani", "ustu", "alti", "onu", "arkasi", "bitisigi", "girisi", "cikisi", "kosesi", "civari"}  # "cami karşısı": what stands before is no name
UNIT_MARKS = {"kat", "daire", "d", "k", "blok", "ic"}
TYPO_RATIO = 5  # a word is a slip of another that is one edit away and at least so many times as frequent
PRIOR = 20  # pairs that the starting shares among matches are worth
MOST_DISTRICTS = 20_000  # names that every task is handed; more are an error, not a cut
COMPARED = ("name", "quarter", "postcode")
NAMESAKE = 1e-3  # share of pairs of different streets of a district and kind whose names agree, or are a slip apart
APART = 1e-6  # share of matches whose street names are more than slips apart: held, as another name is another street; blocks share a word, so it can't be learned

_TOKEN = re.compile(r"\d+|[a-z]+|[^\sa-z\d]")


def parse(text: str | None, district: str | None, districts: set[str], outer: tuple[str, ...] = ()) -> dict | None:
    """Components of one address, or None without a street and house number. The column's district stands before the text's; ``outer`` are
    folded names of larger areas, which end a name as districts do."""
    if not text:
        return None
    tokens = _TOKEN.findall(folded(text))
    out: dict = {"district": district_key(district), "quarter": None, "postcode": None}
    words = [t if t[0].isalnum() else None for t in tokens]
    for t in words:
        if t and t in districts and not out["district"]:
            out["district"] = t
        if t and len(t) == 5 and t.isdigit():
            out["postcode"] = t
    at = next((i for i, t in enumerate(words) if t in STREET_KINDS), None)
    if at is None or not out["district"]:
        return None

    def before(i: int) -> list[str]:
        """All words of the name that ends right before position i: back to a mark, a number, another component or an area."""
        name: list[str] = []
        while (i := i - 1) >= 0:
            t = words[i]
            if t is None:
                if tokens[i] == "." and i and words[i - 1] and words[i - 1].isdigit() and not name:
                    continue  # 1105. Sokak
                break
            if t.isdigit():
                if not name and len(t) < 5:
                    name.insert(0, t)
                break
            if t in QUARTER_MARKS or t in districts or t in outer or t in STREET_KINDS or t in UNIT_MARKS and len(t) > 1 or t in LANDMARK_ENDS and name:
                break
            name.insert(0, t)
        return name

    name = before(at)
    if not name:
        return None
    quarter = next((q for i, t in enumerate(words) if t in QUARTER_MARKS and (q := before(i)) and not q[0].isdigit()), None)
    number = letter = None
    for start in (i for i in [at + 1, *[k + 1 for k, t in enumerate(words) if t in NUMBER_MARKS]]):
        j = start
        while j < len(words) and (words[j] is None and tokens[j] in ".,;:-|/" or words[j] in NUMBER_MARKS):
            j += 1
        if j < len(words) and words[j] and words[j].isdigit() and len(words[j]) < 5:
            number = str(int(words[j]))
            k = j + 1
            if k < len(words) and words[k] is None and tokens[k] in "/-":
                k += 1
            if k < len(words) and words[k] and len(words[k]) == 1 and words[k].isalpha() and not (words[k] in UNIT_MARKS | NUMBER_MARKS and k + 1 < len(words) and (tokens[k + 1] in ":." or tokens[k + 1].isdigit())):
                letter = words[k]
            break
    if number is None:
        return None
    return out | {"name": " ".join(name), "quarter": " ".join(quarter) if quarter else None, "kind": STREET_KINDS[words[at]], "number": number, "letter": letter or ""}


def district_key(district: str | None) -> str | None:
    words = re.findall(r"[a-z]+", folded(district)) if district else []
    return " ".join(w for w in words if w not in ("ilcesi", "ilce", "merkez")) or None


FORM = ("district", "quarter", "postcode", "name", "kind", "number", "letter")


def _parsed(districts: set[str], outer: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(i, p) for i, t, d in zip(pdf["id"], pdf["text"], pdf["district"]) if (p := parse(t, d, districts, outer))]
            yield pd.DataFrame([[i, *[p[c] for c in FORM]] for i, p in found], columns=["id", *FORM], dtype=object)

    return run


def near(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours apart; names with digits only if equal. Built-in expressions."""
    swapped = F.exists(F.sequence(F.lit(1), F.length(a) - 1), lambda i: F.concat(F.left(a, i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    edits = F.levenshtein(a, b)
    return (a == b) | (~a.rlike("[0-9]") & ~b.rlike("[0-9]") & ((edits <= 1) | ((edits == 2) & (F.length(a) == F.length(b)) & (F.length(a) > 1) & swapped)))


def _corrections(words: DataFrame, ratio: float) -> DataFrame:
    """(word, right): for words, marked with their field, that are slips of a more frequent one of the same field. Candidates share a deletion of
    one letter; very short words have too many neighbours to say which was meant and are left to the weights."""
    counted = words.where("word is not null and not word rlike '^.:[0-9]+$'").groupBy("word").agg(F.sum("n").alias("n"))
    gone = F.array_distinct(F.concat(F.array("word"), F.transform(F.sequence(F.lit(3), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.col("word").substr(i + 1, F.length("word"))))))
    keyed = stored(counted.where(F.length("word") > 5).withColumn("key", F.explode(gone)), "words")
    other = keyed.select("key", F.col("word").alias("right"), F.col("n").alias("m"))
    pairs = keyed.join(other, "key").where((F.col("m") >= F.col("n") * ratio) & (F.left("word", F.lit(2)) == F.left("right", F.lit(2)))).select("word", "n", "right", "m").distinct()
    return pairs.where(near(F.col("word"), F.col("right"))).groupBy("word").agg(F.max_by("right", F.struct("m", "right")).alias("right"))


def sound(word: Column) -> Column:
    """Street-sound key: consonants, alike ones taken together, doubled ones once; digits stay."""
    key = F.regexp_replace(F.translate(word, "bdgvzj", "ptkfsc"), "[aeiouy]", "")
    return F.regexp_replace(key, r"(.)\1+", "$1")


def _levels(a: str, b: str) -> Column:
    """Comparison pattern: of each component 0 equal, 1 a slip apart, 2 different, 3 missing in either."""
    out = []
    for c in COMPARED:
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        out.append(F.when(x.isNull() | y.isNull(), 3).when(x == y, 0).when(near(x, y), 1).otherwise(2).cast("int"))
    return F.array(*out).alias("pattern")


def chance_levels(forms: DataFrame) -> list[tuple[float, ...]]:
    """Of each compared component, the shares of the levels among any two forms of one district, over all forms: what agrees by chance. Slips apart are taken
    to be as rare as equal ones. Names are what tells streets apart: two streets of a district hardly share one (NAMESAKE)."""
    out: list[tuple[float, ...]] = [(NAMESAKE, NAMESAKE, 1 - 2 * NAMESAKE, 0.0)]
    for c in COMPARED[1:]:
        each = forms.groupBy("district", c).agg(F.count("*").cast("double").alias("n"))
        there = F.col(c).isNotNull()
        each = each.groupBy("district").agg(F.sum("n").alias("all"), F.sum(F.when(there, F.col("n")).otherwise(0.0)).alias("known"), F.sum(F.when(there, F.col("n") * F.col("n")).otherwise(0.0)).alias("equal"))
        pairs, known, equal = each.agg(F.sum(F.col("all") * F.col("all")), F.sum(F.col("known") * F.col("known")), F.sum("equal")).first()
        pairs = pairs or 1.0
        same, missing = (equal or 0.0) / pairs, 1 - (known or 0.0) / pairs
        levels = [max(x, 1e-4) for x in (same, min(same, 0.05), 1 - missing - same - min(same, 0.05), missing)]
        out.append(tuple(x / sum(levels) for x in levels))
    return out


def linkage_weights(patterns: list[tuple[tuple[int, ...], int]], chance: list[tuple[float, ...]], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """log2 odds of a match for each comparison pattern (level 0 agrees, 1 a slip apart, 2 differs, 3 missing). How often the levels come
    about by ``chance`` is given; their shares among matches, and the share of matches, are estimated by expectation-maximization over counted patterns."""
    if not patterns:
        return {}
    fields = range(len(patterns[0][0]))
    m0 = [(0.58 * (1 - c[3]) / 0.65, 0.05 * (1 - c[3]) / 0.65, 0.02 * (1 - c[3]) / 0.65, c[3]) for c in chance]  # a missing value says nothing by itself
    m, u = [list(x) for x in m0], chance
    m[0][2] = APART
    share, total = 0.3, sum(n for _, n in patterns)

    def odds(p: tuple[int, ...]) -> float:
        return math.log(share / (1 - share)) + sum(math.log(max(m[f][p[f]], 1e-9) / max(u[f][p[f]], 1e-9)) for f in fields)

    for _ in range(rounds):
        g = [1 / (1 + math.exp(-max(-60, min(60, odds(p))))) for p, _ in patterns]
        hit = sum(w * n for w, (_, n) in zip(g, patterns))
        share = min(0.999, max(0.001, (hit + 0.3 * PRIOR) / (total + PRIOR)))
        for f in fields:
            for level in range(4):
                m[f][level] = (sum(w * n for w, (p, n) in zip(g, patterns) if p[f] == level) + PRIOR * m0[f][level]) / (hit + PRIOR)
        m[0][2] = APART
    return {p: odds(p) / math.log(2) for p, _ in patterns}


def address_forms(df: DataFrame, key: str, text: str, district: str, outer: tuple[str, ...] = (), typo_ratio: float = TYPO_RATIO) -> tuple[DataFrame, DataFrame]:
    """(rows: id, form; forms: form and its components put right). Stored."""
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), F.col(district).alias("district")).where("id is not null and text is not null")
    named = F.translate(F.regexp_replace("district", r"(?i)[\s  ]*(ilçesi|ilcesi)[\s ]*$", ""), "İIıŞşĞğÜüÖöÇç", "iiissgguuoocc")
    names = rows.where("district is not null").select(F.trim(F.lower(named)).alias("name")).distinct().limit(MOST_DISTRICTS + 1).collect()
    if len(names) > MOST_DISTRICTS:
        raise ValueError(f"column {district!r} holds more than {MOST_DISTRICTS} names: no districts")
    districts = {district_key(r.name) for r in names} - {None}
    parsed = rows.mapInPandas(_parsed(districts, outer), "id string, " + ", ".join(f"{c} string" for c in FORM))
    parsed = stored(parsed.groupBy("id").agg(F.min(F.struct(*FORM)).alias("x")).select("id", "x.*"), "parsed")
    # words are counted over all rows; each distinct name is put right once
    # a slip is one of a word of the same place: last words of names (n), those before (f), quarters (q)
    last = F.size(F.split("name", " ")) - 1
    marked = [F.transform(F.split("name", " "), lambda w, i: F.concat(F.when(i == last, "n:").otherwise("f:"), w)), F.transform(F.split("quarter", " "), lambda w: F.concat(F.lit("q:"), w))]
    whole = stored(parsed.select(F.explode(F.array_compact(F.array(*[F.concat_ws(" ", m) for m in marked]))).alias("whole")).where("whole <> ''").groupBy("whole").agg(F.count("*").alias("n")), "names")
    words = whole.select("whole", "n", F.posexplode(F.split("whole", " ")).alias("at", "word"))
    right = _corrections(words, typo_ratio)
    put = words.join(right, "word", "left").groupBy("whole").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("right", "word").alias("w")))).alias("all"))  # the words of one name
    put = stored(put.select(F.col("whole"), F.array_join(F.transform("all", lambda x: F.substring(x["w"], 3, 1000)), " ").alias("put")), "put-right")
    fixed = parsed
    for c in ("name", "quarter"):
        of_quarter = F.col("whole").startswith("q:")
        own = put.where(of_quarter if c == "quarter" else ~of_quarter).select(F.array_join(F.transform(F.split("whole", " "), lambda w: F.substring(w, 3, 1000)), " ").alias(c), F.col("put").alias("__r"))
        fixed = fixed.join(own, c, "left").withColumn(c, F.coalesce("__r", c)).drop("__r")
    fixed = fixed.withColumn("form", F.xxhash64(*[F.coalesce(F.col(c), F.lit("\0")) for c in FORM]))
    fixed = stored(fixed.select("id", "form", *FORM), "forms")
    return fixed.select("id", "form"), fixed.groupBy(F.col("form"), *FORM).agg(F.count("*").alias("n"))


def link_addresses(forms: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """(form_a, form_b, weight), form_a <= form_b: pairs of forms, and forms of several rows with themselves, whose linkage weight reaches ``min_weight``.
    District, house number, letter and kind of street are contradictions where they differ, so they are part of every block; what the
    weights decide is whether different names, quarters and postcodes, or missing ones, are the same place's."""
    base = F.concat_ws("|", "district", "number", "letter", "kind")
    # each word's sound: a slip in one word leaves the other; a single word is blocked by its first and last letters too
    sounds = F.transform(F.split("name", " "), lambda w: F.concat_ws("|", F.lit("s"), sound(w)))
    ends = F.array(F.concat_ws("|", F.lit("l"), F.left("name", F.lit(3))), F.concat_ws("|", F.lit("r"), F.right("name", F.lit(3))))
    keys = F.concat(sounds, F.when(F.instr("name", " ") > 0, F.array().cast("array<string>")).otherwise(ends), F.array_compact(F.array(F.concat(F.lit("p|"), F.col("postcode")))))
    blocked = forms.withColumn("block", F.explode(F.array_distinct(keys))).withColumn("block", F.concat_ws("|", base, "block"))
    a, b = blocked.alias("a"), blocked.select(*[F.col(c).alias(c) for c in blocked.columns]).alias("b")
    met = (F.col("a.block") == F.col("b.block")) & ((F.col("a.form") < F.col("b.form")) | ((F.col("a.form") == F.col("b.form")) & (F.col("a.n") > 1)))
    pairs = stored(a.join(b, met).select(F.col("a.form").alias("form_a"), F.col("b.form").alias("form_b"), _levels("a", "b")).distinct(), "compared")
    patterns = [(tuple(r.pattern), r.n) for r in pairs.groupBy("pattern").agg(F.count("*").alias("n")).collect()]  # at most 4 ** 3
    weights = linkage_weights(patterns, chance_levels(forms))
    if not weights:
        return pairs.select("form_a", "form_b", F.lit(0.0).alias("weight")).where("false")
    known = F.create_map(*[F.lit(x) for p, w in weights.items() for x in ("".join(map(str, p)), float(w))])
    weighed = pairs.withColumn("weight", F.try_element_at(known, F.array_join(F.col("pattern").cast("array<string>"), "")))
    return weighed.where(F.col("weight") >= min_weight).select("form_a", "form_b", "weight")


def same_places(df: DataFrame, key: str = "id", text: str = "location_text", district: str = "district", outer: tuple[str, ...] = (), min_weight: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(members: id, form; links: form_a, form_b, weight), form_a <= form_b: each row with an address and its parsed form, and the links between forms that
    denote the same place; a form linked to itself stands for all pairs of its rows. Rows without street, number or district, NULL keys
    and texts have no form; a repeated key counts once. Members aren't expanded into pairs."""
    rows, forms = address_forms(df, key, text, district, outer)
    return rows, link_addresses(forms, min_weight)


def place_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: links spelled out for rows."""
    left, right = members.select(F.col("id").alias("x"), F.col("form").alias("form_a")), members.select(F.col("id").alias("y"), F.col("form").alias("form_b"))
    met = links.select("form_a", "form_b").join(left, "form_a").join(right, "form_b").where((F.col("form_a") != F.col("form_b")) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b) of the rows of news that denote the same place, spelled out as TESTDATA.md asks."""
    return place_pairs(*same_places(table(spark, sf_dir, "news"), outer=("kartalya",)))
