"""Line dedup by a fixed-depth log-template tree, in SQL functions only.

Every line that has a word descends a tree of fixed depth: first by its
number of tokens, then by its leading tokens, where a token with a digit is a
variable field.  Two kinds of template live in a leaf: a masked line that
recurs as it is, and the leaf's general template, whose position holds a token
where more than half of the leaf's other lines agree and a wildcard
elsewhere.  A line belongs to the general template when enough of its tokens
beyond the leading ones, which a leaf's lines share anyway, match.  Templates found in ``min_docs`` different texts are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, materialise

FIELD = "<*>"
#: A token that has a digit.
VARIABLE = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def masked(line: Column) -> Column:
    """The line's tokens with variable fields masked, joined by one space."""
    fields = F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, FIELD)).otherwise(line)
    return F.array_join(F.array_remove(F.split(fields, SPACE_CLASS), ""), " ")


def line_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = 3,
    similarity: float = 0.6,
    min_docs: int = 5,
    keep_first: bool = False,
) -> DataFrame:
    """Drop the lines whose template recurs in ``min_docs`` or more texts.

    Equal texts count as one, so that copies of a document do not turn its own
    lines into templates.  With ``keep_first`` the smallest id that has a
    template keeps its lines, and only later ones lose them.  Returns all
    columns of ``docs`` with the new text, ``n_lines`` and ``n_dropped``.

    Null texts stay null and empty ones empty; lines without a word are kept;
    rows that repeat an id are treated alike row by row; a null id keeps its
    place but never comes first; an empty table gives no rows; extra columns
    are carried, and the two counts replace columns of their names.
    """
    carried = docs.drop("n_lines", "n_dropped")
    body = F.xxhash64(text_col)
    rows = docs.select(F.col(id_col).alias("doc"), body.alias("body"), F.split(text_col, "\n").alias("lines")).filter("lines is not null")
    # Each step of a line runs once: a place and text, then its masked form, then the hashes of that.
    placed = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("pos"), x.alias("x"))), lambda e: e.x.rlike(WORD_CLASS))
    shaped = F.transform(placed, lambda e: F.struct(e.pos.alias("pos"), masked(e.x).alias("m")))
    lines = rows.select("doc", "body", F.explode(shaped).alias("e")).select("doc", "body", "e.pos", "e.m")
    # Hashes stand for lines: 96 bits for a masked line, 64 for its leaf.
    n = F.length("m") - F.length(F.replace(F.col("m"), F.lit(" "), F.lit(""))) + 1
    lines = lines.select("doc", "body", "pos", F.xxhash64("m").alias("k1"), F.hash("m").alias("k2"), n.alias("n"), "m")
    lines = lines.select("doc", "body", "pos", "k1", "k2", F.xxhash64("n", F.substring_index("m", " ", depth)).alias("leaf"), F.when(F.col("n") > depth, F.col("m")).alias("m"))
    # The masked text lies in a column of its own, which only lines of busy leaves are read for.
    lines = materialise(lines, "lines")

    first = F.min("doc").alias("first")
    longer = F.max(F.col("m").isNotNull()).alias("longer")
    exact = lines.groupBy("k1", "k2", "leaf", "body").agg(first, longer)
    exact = exact.groupBy("k1", "k2", "leaf").agg(F.count("*").alias("n_docs"), F.min("first").alias("first"), F.max("longer").alias("longer"))
    exact = materialise(exact, "line-counts")
    recurring = exact.filter(F.col("n_docs") >= min_docs).select("k1", "k2", "first")

    # The leaf's general template, from the masked lines that do not recur by themselves.
    rare = exact.filter((F.col("n_docs") < min_docs) & F.col("longer"))
    full = rare.groupBy("leaf").agg(F.sum("n_docs").alias("leaf_docs"), F.count("*").alias("leaf_lines")).filter((F.col("leaf_docs") >= min_docs) & (F.col("leaf_lines") > 1))
    full = materialise(full.select("leaf", "leaf_docs"), "line-leaves")
    texts = lines.select("leaf", "k1", "k2", "m").join(full.select("leaf"), "leaf").groupBy("k1", "k2").agg(F.min("m").alias("m"))
    rest = materialise(rare.select("leaf", "k1", "k2", "n_docs", "first").join(full, "leaf").join(texts, ["k1", "k2"]), "line-rest")
    tokens = rest.select("leaf", "leaf_docs", "k1", "k2", "n_docs", "first", F.posexplode(F.split("m", " ")).alias("pos", "token"))
    common = tokens.groupBy("leaf", "pos", "token").agg(F.sum("n_docs").alias("c"), F.first("leaf_docs").alias("leaf_docs")).filter(F.col("c") * 2 > F.col("leaf_docs")).select("leaf", "pos", "token")
    general = common.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("pos", "token"))).alias("general"))
    # Tables on both sides of a join let Spark split a busy leaf.
    general = materialise(general, "line-general")
    words = F.split("m", " ")
    agree = F.size(F.filter(F.transform(words, lambda t, i: (i >= depth) & F.coalesce(F.element_at("general", i) == t, F.lit(False))), lambda hit: hit))
    members = rest.join(general, "leaf").filter(agree >= (F.size(words) - depth) * similarity).select("leaf", "k1", "k2", "n_docs", "first")
    members = materialise(members, "line-members")
    leaves = members.groupBy("leaf").agg(F.sum("n_docs").alias("n_docs"), F.min("first").alias("leaf_first")).filter(F.col("n_docs") >= min_docs).select("leaf", "leaf_first")
    generalised = members.join(materialise(leaves, "line-busy"), "leaf").select("k1", "k2", F.col("leaf_first").alias("first"))

    templates = materialise(recurring.union(generalised), "templates")
    hits = lines.select("doc", "body", "pos", "k1", "k2").join(templates, ["k1", "k2"])
    if keep_first:
        hits = hits.filter(~F.col("doc").eqNullSafe(F.col("first")))
    # One set per document, of its own lines' places; equal rows share it.
    drops = hits.groupBy(F.col("doc").alias("_tf_doc"), F.col("body").alias("_tf_body")).agg(F.collect_set("pos").alias("_tf_drops"))
    same = carried[id_col].eqNullSafe(drops["_tf_doc"]) & (F.xxhash64(carried[text_col]) == drops["_tf_body"]) & carried[text_col].isNotNull()
    split = F.split(F.col(text_col), "\n")
    stay = F.filter(F.transform(split, lambda x, i: F.when(~F.array_contains("_tf_drops", i), x)), lambda x: x.isNotNull())
    out = carried.join(drops, same, "left").drop("_tf_doc", "_tf_body")
    lines_of = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(split)).cast("long")
    dropped = F.when(F.col("_tf_drops").isNull(), F.lit(0)).otherwise(F.size("_tf_drops")).cast("long")
    text = F.when(F.col("_tf_drops").isNull(), F.col(text_col)).otherwise(F.array_join(stay, "\n"))
    out = out.withColumns({"n_lines": lines_of, "n_dropped": dropped})
    return out.withColumn(text_col, text).select(*carried.columns, "n_lines", "n_dropped")


def oracle_sql(depth: int = 3, similarity: float = 0.6, min_docs: int = 5) -> str:
    variable, word = VARIABLE, WORD_CLASS
    return f"""
WITH l AS (SELECT doc_id, text AS body, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT doc_id, body, i, line, regexp_matches(line, '{word}') AS has,
  array_to_string(regexp_extract_all(regexp_replace(line, '{variable}', '{FIELD}', 'g'), '{word}'), ' ') AS m FROM l),
e AS (SELECT m, string_split(m, ' ') AS w, count(DISTINCT body) AS n_docs FROM m WHERE has GROUP BY m),
f AS (SELECT *, len(w) AS n, array_to_string(w[1:{depth}], ' ') AS head FROM e),
rest AS (SELECT * FROM (SELECT *, sum(n_docs) OVER p AS leaf_docs, count(*) OVER p AS leaf_lines FROM f WHERE n_docs < {min_docs} AND n > {depth} WINDOW p AS (PARTITION BY n, head))
  WHERE leaf_docs >= {min_docs} AND leaf_lines > 1),
tok AS (SELECT n, head, m, n_docs, leaf_docs, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM rest),
com AS (SELECT n, head, pos, token FROM tok GROUP BY n, head, pos, token HAVING sum(n_docs) * 2 > min(leaf_docs)),
mem AS (SELECT tok.n, tok.head, m, min(n_docs) AS n_docs FROM tok JOIN com ON tok.n = com.n AND tok.head = com.head AND tok.pos = com.pos AND tok.token = com.token
  GROUP BY tok.n, tok.head, m HAVING count(*) FILTER (WHERE tok.pos > {depth}) >= (tok.n - {depth}) * {similarity}),
gen AS (SELECT m FROM (SELECT m, sum(n_docs) OVER (PARTITION BY n, head) AS s FROM mem) WHERE s >= {min_docs}),
t AS (SELECT m FROM e WHERE n_docs >= {min_docs} UNION SELECT m FROM gen),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE has AND m IN (SELECT m FROM t)) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT (has AND m IN (SELECT m FROM t))), '') AS text FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped, md5(k.text) AS text_md5
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id"""
