"""Line dedup: lines that many documents share stay in one of them.

Lines are exploded with their position, the keys hashed to 128 bits, the
distinct documents of each hash counted (pre-aggregated before each shuffle),
and the hashes over the threshold joined back, which gives for each document
the positions to drop. A document is put together again from the positions
that are left. Only hashes, ids and positions are grouped by hash; a join is
the one place where a hot line's rows meet, and Spark splits its partitions.

Defined cases: a null or empty text is one empty line; a document with a null
id keeps all lines and isn't counted; rows with the same id count as one
document, and each keeps or loses lines by itself; a line twice in a document
counts once, and a keeper keeps both; an empty table gives no rows; very long
texts are one row as a whole. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, release, staged

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANK))
    # lower() is much faster than translate() and the same on ASCII
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cut to the lines kept, and __n_lines, __n_dropped (with more underscores after, where docs has such columns).

    A key of at least min_chars code points in at least min_docs documents
    loses its lines everywhere but in the largest id that holds it.
    """
    doc, same, lines, gone, n_lines, n_dropped = free(docs.columns, "doc", "same", "lines", "gone", "__n_lines", "__n_dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .select("id", "text", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "text", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )
    hashed = staged(hashed, "hashes")  # texts are split and hashed once
    common = (
        hashed.groupBy("h1", "h2", "id")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("docs"), F.max("id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    common = staged(common, "common")  # so that the join deals both sides anew, and a hot line's partition can be split
    dropped = hashed.join(common, ["h1", "h2"]).where("id <> keeper").groupBy(F.col("id").alias(doc), F.col("text").alias(same)).agg(F.collect_set("pos").alias(gone))
    dropped = staged(dropped, "dropped")
    release(hashed, common)
    # always by merge: positions take many times what their file does, and a plan by the file's size would leave texts where they are on small inputs only
    both = docs.withColumn(lines, F.split(text, "\n", -1)).join(dropped.hint("merge"), (F.col(id_col) == F.col(doc)) & (F.xxhash64(text) == F.col(same)), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n"))
    return both.select(
        *[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.size(lines).cast("long").alias(n_lines),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias(n_dropped),
    )


def digest(docs: DataFrame) -> DataFrame:
    return line_dedup(docs.select("doc_id", "text")).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*)::BIGINT AS n_lines,
  count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k)
GROUP BY doc_id
"""
