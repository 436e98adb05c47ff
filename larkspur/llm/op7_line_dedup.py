"""Line dedup by winnowing over line hashes, in DataFrame functions alone.

Only lines with a word count as lines here.  A unit is a run of consecutive lines, the shortest from its first line on that has
``LEAST_WORDS`` words; its hash is taken over the hashes of its lines.  Of the units that lie within ``SURE_WORDS`` words from some
line on, those of the least hash are selected as fingerprints: any run of lines of so many words that occurs twice has a
fingerprint in common, while most units are not selected.  Positions of a fingerprint are joined to the first of them in
document order, verified by the line hashes, and extended line by line both ways along that first copy; stretches that
touch are one; and they, the later copies, are deleted.  Every line deleted equals an earlier line, so the first copy of a line
always stays.

How it scales: lines are reduced to hashes at the scan.  Positions join only the first position of their fingerprint (one row
a fingerprint after a group-by with partial aggregation), never each other.  A position carries the hashes of the lines up to
``SURE_WORDS`` words before and after it, and is extended along these: a longer common run holds another fingerprint there, which is
extended in its turn.  So no row meets a whole other text, however long it is or often copied.  Texts are read again with the
stretches to delete beside them; they move only if there are more than ``FEW`` such documents.

Defined results: lines are split at \\n; words are runs of characters other than \\x20 and \\x09-\\x0D; null and empty texts and
texts of fewer words than a unit stay as they are; rows of equal id and text share one result (a copy under the same id isn't
an earlier document); documents come in the order of their id (null first), of equal ids in the order of their text's hash;
units of equal, least hash are all selected; repeated runs of at least SURE_WORDS words are found without fail, those of fewer than
LEAST_WORDS stay; lines without a word between the lines of a stretch go with it; a text all of whose lines go becomes empty; other columns
pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.llm import common

#: Words of a unit: repeated runs of fewer words stay.
LEAST_WORDS = 30
#: Repeated runs of so many words are found without fail.
SURE_WORDS = 50
#: Documents with lines to delete whose keys may be broadcast.
FEW = 100_000


NULL_ID = -(2**63)
WORD = r"[^\x20\x09-\x0D]"


def _keyed(doc_id: str, text: str):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)), F.xxhash64(text)


def number(text: Column) -> Column:
    """The first 60 bits of the MD5 sum of a text."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def line_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per line with a word of each distinct (id, text): k (the id), r (hash of the text), i (its number), h, and words before it."""
    k, r = _keyed(doc_id, text)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    line = lambda x: F.struct(number(x).alias("h"), F.size(F.regexp_extract_all(x, F.lit(WORD + "+"), F.lit(0))).alias("w"))
    rows = docs.select(k.alias("k"), r.alias("r"), F.filter(F.transform(lines, line), lambda x: x["w"] > 0).alias("lines"))
    line = rows.dropDuplicates(["k", "r"]).select("k", "r", F.posexplode("lines").alias("i", "line")).select("k", "r", "i", "line.h", F.col("line.w").cast("long").alias("w"))
    document = Window.partitionBy("k", "r").orderBy("i")
    return line.withColumn("before", F.coalesce(F.sum("w").over(document.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def units(lines: DataFrame, least_words: int, sure_words: int) -> DataFrame:
    """All units: k, r, first line i, n lines, hash f, whether it is selected; and hashes of the lines from i on and (backwards) before it."""
    words = Window.partitionBy("k", "r").orderBy("before")
    own, wide = words.rangeBetween(0, least_words - 1), words.rangeBetween(0, least_words + sure_words - 1)
    unit = lines.select("k", "r", "i", "before", F.count("*").over(own).cast("int").alias("n"), F.sum("w").over(own).alias("words"), F.collect_list("h").over(wide).alias("ahead"), F.collect_list("h").over(words.rangeBetween(-sure_words, -1)).alias("back"))
    f = F.when(F.col("words") >= least_words, number(F.array_join(F.slice("ahead", F.lit(1), F.col("n")).cast("array<string>"), ",")))
    unit = unit.withColumn("f", f)
    # a unit is selected if it is the least from some line on whose SURE_WORDS words hold it
    room = sure_words - least_words
    unit = unit.withColumn("least", F.min("f").over(words.rangeBetween(0, room)))
    unit = unit.withColumn("selected", F.max("least").over(words.rangeBetween(-room, 0)) == F.col("f"))
    return unit.where(F.col("f").isNotNull()).select("k", "r", "i", "n", "f", "selected", "ahead", F.reverse("back").alias("back"))


def _same(x, y):
    """How many leading elements two arrays share."""
    differs = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(x), F.size(y))).cast("int")


def matches(positions: DataFrame) -> DataFrame:
    """k, r and the first and last line (a, b) of the run around each selected position that equals one around its first copy."""
    first = positions.groupBy("f").agg(F.min(F.struct("k", "r", "i", "ahead", "back")).alias("s"), F.count("*").alias("times")).where("times > 1")
    again = positions.join(first, "f").where(~F.struct("k", "r", "i").eqNullSafe(F.struct("s.k", "s.r", "s.i")))
    again = again.withColumn("on", _same(F.col("ahead"), F.col("s.ahead"))).where("on >= n")
    return again.select("k", "r", (F.col("i") - _same(F.col("back"), F.col("s.back"))).alias("a"), (F.col("i") + F.col("on") - 1).alias("b"))


def stretches(docs: DataFrame, least_words: int, sure_words: int, doc_id: str, text: str) -> DataFrame:
    """k, r and the stretches to delete, as pairs of numbers of lines with a word."""
    selected = units(line_hashes(docs, doc_id, text), least_words, sure_words).where("selected").drop("selected")
    found = common.materialize(matches(common.materialize(selected, "fingerprints")), "line-matches").distinct()
    document = Window.partitionBy("k", "r").orderBy("a", "b")
    apart = F.col("a") > F.coalesce(F.max("b").over(document.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1
    placed = found.withColumn("stretch", F.sum(apart.cast("int")).over(document.rowsBetween(Window.unboundedPreceding, 0)))
    whole = placed.groupBy("k", "r", "stretch").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return whole.groupBy("k", "r").agg(F.collect_list(F.struct("a", "b")).alias("stretches"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, sure_words: int = SURE_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with all its columns, later copies of repeated runs of lines deleted from the text."""
    with common.scratch(docs.sparkSession):
        gone = common.materialize(stretches(docs, least_words, sure_words, doc_id, text), "line-stretches", keep=True)
    few = F.broadcast(gone) if gone.count() <= FEW else gone
    k, r = _keyed(doc_id, text)
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), k.alias("row_k"), r.alias("row_r"))
    joined = rows.join(few, (F.col("row_k") == F.col("k")) & (F.col("row_r") == F.col("r")), "left")
    lines = F.split("text", "\n", -1)
    places = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
    at = lambda x: F.element_at(places, (x + 1).cast("int"))
    spans = F.transform("stretches", lambda s: F.struct(at(s["a"]).alias("a"), at(s["b"]).alias("b")))
    short = F.array_join(F.filter(F.col("cut.lines"), lambda x, i: ~F.exists("cut.spans", lambda s: i.between(s["a"], s["b"]))), "\n")
    joined = joined.withColumn("cut", F.when(F.col("stretches").isNotNull(), F.struct(lines.alias("lines"), spans.alias("spans"))))
    # as the output of a generator, it is computed once a row, whatever is asked of the text later on
    joined = joined.select("row", "text", "cut", F.explode(F.array(short)).alias("short"))
    clean = F.when(F.col("cut").isNull(), F.col("text")).when(F.col("short").rlike(WORD), F.col("short")).otherwise("")
    return joined.select(*(clean.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return dedup_lines(docs).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.char_length("text").cast("long").alias("n_chars"))


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents
), line AS (
  SELECT *, substr(md5(line), 1, 15) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS i FROM (
    SELECT doc_id, line, place, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM split)
  WHERE w > 0
), summed AS (
  SELECT *, CAST(('0x' || x) AS BIGINT) AS h, coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM line
), framed AS (
  SELECT doc_id, i, before, count(*) OVER own AS n, sum(w) OVER own AS words, list(h) OVER wide AS ahead, coalesce(list_reverse(list(h) OVER prior), []) AS back FROM summed
  WINDOW own AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 29 FOLLOWING),
         wide AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 79 FOLLOWING),
         prior AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN 50 PRECEDING AND 1 PRECEDING)
), unit AS (
  SELECT *, CASE WHEN words >= 30 THEN substr(md5(array_to_string(ahead[1:n], ',')), 1, 15) END AS f FROM framed
), winnowed AS (
  SELECT *, min(f) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 20 FOLLOWING) AS least FROM unit
), marked AS (
  SELECT *, max(least) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN 20 PRECEDING AND CURRENT ROW) = f AS selected FROM winnowed
), ranked AS (
  SELECT *, first_value(ahead) OVER o AS sa, first_value(back) OVER o AS sb, row_number() OVER o AS copy
  FROM marked WHERE selected WINDOW o AS (PARTITION BY f ORDER BY doc_id, i)
), match AS (
  SELECT doc_id, i, n, i - coalesce(list_position(list_transform(range(least(len(back), len(sb))), lambda t: back[t + 1] = sb[t + 1]), false) - 1, least(len(back), len(sb))) AS a,
         i + coalesce(list_position(list_transform(range(least(len(ahead), len(sa))), lambda t: ahead[t + 1] = sa[t + 1]), false) - 1, least(len(ahead), len(sa))) - 1 AS b
  FROM ranked WHERE copy > 1
), ranges AS (
  SELECT DISTINCT m.doc_id, x.place AS a, y.place AS b FROM match m JOIN line x ON x.doc_id = m.doc_id AND x.i = m.a JOIN line y ON y.doc_id = m.doc_id AND y.i = m.b WHERE m.b - m.i + 1 >= m.n
), touched AS (
  SELECT DISTINCT doc_id FROM ranges
), islands AS (
  SELECT doc_id, i, max(b) AS b, min(a) AS a FROM (
    SELECT m.doc_id, m.a, m.b, sum(CASE WHEN m.a > m.prev + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM (
      SELECT doc_id, a, b, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) AS prev FROM match WHERE b - i + 1 >= n) m)
  GROUP BY doc_id, i
), gone AS (
  SELECT DISTINCT s.doc_id, s.place FROM islands t JOIN line x ON x.doc_id = t.doc_id AND x.i = t.a JOIN line y ON y.doc_id = t.doc_id AND y.i = t.b
  JOIN split s ON s.doc_id = t.doc_id AND s.place BETWEEN x.place AND y.place
), kept AS (
  SELECT s.doc_id, string_agg(line, chr(10) ORDER BY s.place) AS short FROM split s ANTI JOIN gone g ON g.doc_id = s.doc_id AND g.place = s.place GROUP BY s.doc_id
), cleaned AS (
  SELECT d.doc_id, CASE WHEN t.doc_id IS NULL THEN text WHEN regexp_matches(coalesce(short, ''), '[^\x20\x09-\x0D]') THEN short ELSE '' END AS text
  FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN touched t USING (doc_id)
)
SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, CAST(length(text) AS BIGINT) AS n_chars FROM cleaned
"""
