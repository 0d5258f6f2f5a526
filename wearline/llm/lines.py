"""Line dedup by overlapping windows of three lines.

Lines with a word are taken in order; each three that follow one another are a window, known by a 128-bit hash.  So
that a passage on fewer lines is found between any neighbours, two lines of LONG words or more together and one line of
LONG words or more are windows as well.  Of windows that are found more than once in the corpus the first stays - the
least document id, then the least place - and the lines covered by any later one go; places covered by several windows
go once.  Lines without a word stay.

A null text stays null and has no lines; a text of fewer than three lines with words has only such long windows; null
document ids come last; rows equal in id and text count as one document, so they lose the same lines (ties of equal
windows go by id, then by a hash of id and text, then by place); rows of equal id and other texts are told apart by the
text.  All other columns pass, whatever their names; columns called n_lines or n_removed are replaced.  Texts of any
length are cut whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, numbered, spread_join, written

SPAN, LONG = 3, 50
HAS_WORD = r"[^\x20\x09-\x0D]"


def document_key(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each window: doc (id and text hash, ordered), place of its first line among those with words, span, hash."""
    marked = F.transform(F.split(text, "\n"), lambda x: F.struct(F.regexp_count(x, F.lit(WORD)).alias("n"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b")))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), document_key(key, text).alias("doc"), F.filter(marked, lambda x: x["n"] > 0).alias("held"))
    at = lambda i, k: F.get("held", i + k)
    hashed = lambda i, span, name: F.xxhash64(F.lit(span), *(at(i, k)[name] for k in range(span)))
    one = lambda i, span: F.struct(i.alias("place"), F.lit(span).alias("span"), hashed(i, span, "a").alias("h1"), hashed(i, span, "b").alias("h2"))
    n_words = lambda i, span: sum((at(i, k)["n"] for k in range(1, span)), at(i, 0)["n"])
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("held") - 1)), lambda i: F.array(
        F.when(i + SPAN <= F.size("held"), one(i, SPAN)), *(F.when((i + span <= F.size("held")) & (n_words(i, span) >= LONG), one(i, span)) for span in range(1, SPAN))))
    cut = rows.select("id", "doc", F.explode(F.filter(F.flatten(every), lambda w: w.isNotNull())).alias("w"))
    return cut.select("id", "doc", "w.place", "w.span", "w.h1", "w.h2")


def later_places(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document (key hash doc): gone, the sorted places of lines that later occurrences cover."""
    found = windows(docs, key, text)
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("doc"), F.col("place"))
    repeated = written(found.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "lines-repeated")
    later = spread_join(found, repeated, ["h1", "h2"], "n").where(order > F.col("first"))
    covered = later.groupBy("doc").agg(F.collect_set(F.struct("place", "span")).alias("starts"))  # at most a document's lines
    return covered.select("doc", F.array_distinct(F.flatten(F.transform("starts", lambda w: F.sequence(w["place"], w["place"] + w["span"] - 1)))).alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with shorter texts, and n_lines (lines with words) and n_removed."""
    kept = docs.drop("n_lines", "n_removed")
    rows, at = numbered(kept)
    gone = later_places(rows.select(at[key], at[text]), at[key], at[text])
    others = [c for name, c in at.items() if name != text]
    lines = F.split(at[text], "\n")
    # the lines are cut before the join, so that no later expression on the text can cut them again for each line
    rows = rows.select(*others, document_key(at[key], at[text]).alias("doc"), lines.alias("lines"), F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(HAS_WORD), i)), lambda i: i.isNotNull()).alias("worded"))
    rows = rows.join(gone, "doc", "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.transform("gone", lambda p: F.get("worded", p)))
    body = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i))), "\n")
    n_lines, n_removed = (F.coalesce(F.size(c), F.lit(0)).cast("long") for c in ("worded", "gone"))
    return rows.select(*((body if name == text else F.col(c)).alias(name) for name, c in at.items()), F.when(F.col("lines").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(n_removed).cast("long").alias("n_removed"))


#: The same in SQL, over the documents table.
ORACLE = """
    WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
    w AS (SELECT a.doc_id, a.place, 3 AS span, a.line AS l1, b.line AS l2, c.line AS l3 FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.place = a.place + 1 JOIN p c ON a.doc_id = c.doc_id AND c.place = a.place + 2
          UNION ALL SELECT a.doc_id, a.place, 2, a.line, b.line, '' FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.place = a.place + 1 WHERE a.n + b.n >= 50
          UNION ALL SELECT doc_id, place, 1, line, '', '' FROM p WHERE n >= 50),
    r AS (SELECT doc_id, place, span, row_number() OVER (PARTITION BY span, l1, l2, l3 ORDER BY doc_id, place) AS rn FROM w),
    g AS (SELECT DISTINCT doc_id, place + k AS place FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE rn > 1 AND k < span),
    s AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.place IS NULL) AS body, count(p.place) AS n_lines, count(g.place) AS n_removed
          FROM l LEFT JOIN p ON l.doc_id = p.doc_id AND l.pos = p.pos LEFT JOIN g ON p.doc_id = g.doc_id AND p.place = g.place GROUP BY l.doc_id)
    SELECT d.doc_id, CAST(COALESCE(n_lines, 0) AS BIGINT) AS n_lines, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, sha256(COALESCE(body, '')) AS text_sha256
    FROM documents d LEFT JOIN s USING (doc_id)"""
