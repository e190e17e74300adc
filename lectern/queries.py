"""The library's queries over general tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import paths, rates, text
from lectern.functions.align import INSERT, errors_at, placed_scores, scores, tag_sequence, tags_sql
from lectern.operators import dedup, link, score, segments, summary
from lectern.plans import standins
from lectern.plans.standins import SQL_READINGS, SQL_SCORED, sql_distance, sql_edits, sql_middles, sql_normalize, sql_tags, table
from lectern.sources import manifests, sinks, textgrid

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- texts


@query(f"SELECT doc_id, md5({sql_normalize('text')}) AS digest, len({sql_normalize('text')}) AS length FROM documents")
def text_normalize(spark, sf_dir):
    n = text.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("length"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g'), '[\s\x0B\p{Z}]+', ' ', 'g'))) AS digest FROM documents")
def text_normalize_ascii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_ascii(F.col("text"))).alias("digest"))


SQL_CLEAN = r"""lower(trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[\r\n]+', ' ', 'g'), '[^\x20-\x7E]', '', 'g'), ' *< *', ' <', 'g'), ' *> *', '> ', 'g'), '<[^>]*>', ' ', 'g'),
  ' +', ' ', 'g'), ' '), lambda x: NOT regexp_matches(x, '[<>]')), ' '), '[,.''0-9?!`"-]', '', 'g'), ' +', ' ', 'g')))"""


#: Brackets without a counterpart, made from a page's address.
_UNBALANCED = "url || ' < foo bar ' || url || ' > b< ' || url || ' >c d > e'"


@query(f"SELECT page_id, md5({SQL_CLEAN.format('html')}) AS digest, {SQL_CLEAN.format('(' + _UNBALANCED + ')')} AS unbalanced FROM pages")
def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.clean(F.col("html"))).alias("digest"), text.clean(F.expr(_UNBALANCED)).alias("unbalanced"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s\x0B\p{Z}]+')) AS BIGINT) AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN regexp_matches(lower(w), '^[^a-z]*[b-df-hj-np-tv-z]') AND NOT regexp_matches(lower(w), 'a$') THEN w || 'a' ELSE w END), ' ') AS adjusted,
  CASE WHEN p_size % 2 = 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN regexp_matches(lower(w), '^[^a-z]*[b-df-hj-np-tv-z]') AND NOT regexp_matches(lower(w), 'a$') THEN w || 'a' ELSE w END), ' ') ELSE p_name END AS by_type FROM part""")
def letter_adjust(spark, sf_dir):
    kind = F.when(F.col("p_size") % 2 == 0, "Full_Letter_grid").otherwise("passage_num1")
    return table(spark, sf_dir, "part").select("p_partkey", text.add_vowel(F.col("p_name")).alias("adjusted"), text.adjust_letters(F.col("p_name"), kind).alias("by_type"))


@query(r"""SELECT conv_id, turn, nullif(array_to_string(list_filter(regexp_split_to_array(text, '[\s\x0B\p{Z}]+'), lambda t: t <> ''), ' '), '') AS label FROM conversations""")
def label_without_fillers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.without_fillers(F.concat(F.lit("<UM> "), "text", F.lit(" <noise>"))).alias("label"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '([.,?])', ' \1 ', 'g'), '[\s\x0B\p{Z}]+', ' ', 'g'))) AS apart, md5(trim(regexp_replace(regexp_replace(text, '[.,?]', '', 'g'), '[\s\x0B\p{Z}]+', ' ', 'g'))) AS without FROM documents""")
def scoring_text(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.scoring_text(c, lowercase=True, separate_marks=True)).alias("apart"), F.md5(text.scoring_text(c, drop_marks=True)).alias("without"))


# -- names


@query(r"""SELECT page_id, regexp_extract(url, '([^/]+)/*$', 1) AS audio_name, regexp_replace(regexp_extract(url, '([^/]+)/*$', 1), '(.)\.[^.]+$', '\1') AS audio_stem FROM pages""")
def path_keys(spark, sf_dir):
    return paths.with_audio_keys(table(spark, sf_dir, "pages"), "url").select("page_id", "audio_name", "audio_stem")


def _names(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_orderkey") % len(standins.NAMES)).cast("int").alias("k"))
    speaker = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lpad((F.col("l_partkey") % 1_000_000).cast("string"), 6, "0"), F.lit("_"), F.lpad((F.col("l_orderkey") % 1_000_000).cast("string"), 6, "0"), F.lit("_A"))).otherwise(F.concat_ws("_", F.lit("s"), "l_partkey", "l_orderkey", F.lit("x")))
    name = F.element_at(F.array(*[F.lit(n) for n in standins.NAMES]), F.col("k") + 1)
    return d.withColumn("stem", F.concat(speaker, F.lit("-audio_"), F.upper(name), F.when(F.col("k") >= 3, (F.col("l_partkey") % 50).cast("string")).otherwise("")))


_LIST = lambda xs: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"
SQL_NAMES = f"""n AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_orderkey % {len(standins.NAMES)} AS INT) AS k,
  CASE WHEN l_partkey % 3 = 0 THEN lpad(CAST(l_partkey % 1000000 AS VARCHAR), 6, '0') || '_' || lpad(CAST(l_orderkey % 1000000 AS VARCHAR), 6, '0') || '_A' ELSE 's_' || l_partkey || '_' || l_orderkey || '_x' END AS speaker,
  CAST(l_partkey % 50 AS VARCHAR) AS num FROM lineitem)"""


@query(f"""WITH {SQL_NAMES} SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN speaker ELSE array_to_string(list_slice(string_split(speaker, '_'), 1, 3), '_') END AS learner_id,
  replace(replace({_LIST(standins.NAMED_TYPES)}[k + 1], '{{}}', num), '{{}}', num) AS audio_type, {_LIST(standins.NAMED_CATEGORIES)}[k + 1] AS category FROM n""")
def audio_types(spark, sf_dir):
    kind = paths.audio_type(F.col("stem"))
    return _names(spark, sf_dir).select("l_orderkey", "l_linenumber", paths.learner_of(F.col("stem")).alias("learner_id"), kind.alias("audio_type"), paths.category(kind).alias("category"))


@query(f"""WITH {SQL_NAMES} SELECT l_orderkey, l_linenumber, array_to_string(list_slice(string_split(speaker, '_'), 1, 3), '_') AS speaker, 'f' || l_orderkey || '.Wav' AS base, CAST(l_linenumber AS BIGINT) AS number, 'f' || l_orderkey || '.wav' AS old_group,
  'out/' || array_to_string(list_slice(string_split(speaker, '_'), 1, 3), '_') || '/f' || l_orderkey || '_segment' || l_linenumber || '.wav' AS segment_path, 'rel/a/f.wav' AS moved FROM n""")
def segment_names(spark, sf_dir):
    d = _names(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), "l_orderkey", F.lit("_segment"), "l_linenumber", F.lit(".Wav")))
    speaker = paths.speaker_of(F.concat(F.lit("/a/"), F.substring_index("stem", "-audio", 1), F.lit("_1.wav")))
    seg = paths.segment(F.col("file"))
    return d.select("l_orderkey", "l_linenumber", speaker.alias("speaker"), seg["base"].alias("base"), seg["number"].alias("number"), paths.group_and_order(F.col("file"))["group"].alias("old_group"), paths.segment_path("out", speaker, F.concat(F.lit("f"), "l_orderkey"), F.col("l_linenumber")).alias("segment_path"), paths.under_prefix(F.lit("/data/a/f.wav"), "/data", "rel").alias("moved"))


@query("SELECT l_orderkey, l_linenumber, " + _LIST([m for m, _ in standins.MACRO_OF]) + "[l_linenumber] AS macro, " + _LIST([s for _, s in standins.MACRO_OF]) + "[l_linenumber] AS sub FROM lineitem")
def macro_categories(spark, sf_dir):
    kind = F.get(F.array(*[F.lit(t) for t in standins.TYPES]), F.col("l_linenumber") - 1)
    c = paths.macro_and_sub(F.upper(kind))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c["macro"].alias("macro"), c["sub"].alias("sub"))


# -- semi-structured


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, json_valid(props) AS valid, TRY_CAST(event_type AS DOUBLE) AS not_a_number FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), F.lit("k")).try_cast("double").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"), F.col("event_type").try_cast("double").alias("not_a_number"))


# -- dedup

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_SQL_NTH = "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {}) AS n FROM lineitem) WHERE n = 1"


@query(_SQL_NTH.format("l_linenumber, l_partkey, l_suppkey, l_extendedprice"))
def dedup_first(spark, sf_dir):
    return dedup.keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(_SQL_NTH.format("l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC"))
def dedup_last(spark, sf_dir):
    return dedup.keep_last(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("SELECT DISTINCT l_returnflag AS learner_id, l_linestatus AS audio_type, l_linenumber AS audio_file FROM lineitem")
def dedup_scored(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("learner_id"), F.col("l_linestatus").alias("audio_type"), F.col("l_linenumber").alias("audio_file"), F.col("l_orderkey").alias("ord"))
    return dedup.distinct_scored(d).drop("ord")


# -- joins


def _items(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id")).alias("audio_stem"), F.when(F.col("doc_id") % 4 == 0, F.lit(" nan ")).when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 2, F.col("lang")).alias("hyp_text"))


@query("""SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 2 THEN lang ELSE c.text END, '') AS hyp_text FROM documents LEFT JOIN conversations c ON doc_id = conv_id""")
def attach_hypotheses(spark, sf_dir):
    hyps = table(spark, sf_dir, "conversations").select(F.concat(F.lit("d"), "conv_id").alias("audio_stem"), F.col("text").alias("hyp_text"))
    return link.attach_hypotheses(_items(spark, sf_dir), hyps).select("doc_id", "hyp_text")


@query("""WITH t AS (SELECT conv_id, max_by(text, turn) AS text, max_by(role, turn) AS role FROM conversations GROUP BY conv_id)
SELECT doc_id, coalesce(t.text, lang) AS ref_text, coalesce(CASE WHEN t.role = 'user' THEN NULL ELSE t.role END, source) AS canonical_text FROM documents LEFT JOIN t ON doc_id = conv_id""")
def attach_texts(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("audio_stem"), F.col("lang").alias("ref_text"), F.col("source").alias("canonical_text"))
    texts = table(spark, sf_dir, "conversations").select(F.concat(F.lit("d"), "conv_id").alias("audio_stem"), F.col("text").alias("manifest_text"), F.when(F.col("role") == "user", " ").otherwise(F.col("role")).alias("manifest_can_text"), F.col("turn").alias("ord"))
    return link.attach_texts(items, texts).select("doc_id", "ref_text", "canonical_text")


@query("SELECT doc_id, coalesce(b.text, lang) AS canonical_text, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 60 AS INT) END AS passage_num FROM documents LEFT JOIN benchmark b ON doc_id % 2 = 0 AND doc_id % 60 = item_id")
def attach_passages(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("canonical_text"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("passage_num"), F.col("doc_id") % 60)).otherwise("iso_letter_1").alias("audio_type"))
    passages = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("no. "), "item_id", F.lit(" of 9")).alias("raw_num"), F.concat(F.lit(" \t"), "text", F.lit(" \n")).alias("passage_text"))
    return link.attach_passages(items, passages.unionByName(spark.sql("SELECT 'number' AS raw_num, 'header' AS passage_text"))).select("doc_id", "canonical_text", "passage_num")


@query("SELECT o_orderkey, o_custkey AS learner_id, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def attach_metadata(spark, sf_dir):
    meta = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "learner_id")
    return link.attach_metadata(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("learner_id")), meta, ["c_name", "c_mktsegment"]).select("o_orderkey", "learner_id", "c_name", "c_mktsegment")


@query("SELECT c_custkey, coalesce(max_by(o_orderpriority, o_orderkey), '') AS o_orderpriority FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def lookup_last(spark, sf_dir):
    return link.lookup_last(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderpriority", "o_orderkey")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'g/' || s_suppkey || '/A' || s_suppkey || '.TextGrid' WHEN s_suppkey % 4 = 1 THEN 'g/' || s_suppkey || '/b' || s_suppkey || '.TextGrid'
  WHEN s_suppkey % 4 = 2 THEN 'g/' || s_suppkey || '/c.TextGrid' END AS annotation_path FROM supplier""")
def lookup_priority(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("learner_id"), (F.col("s_suppkey") % 4).alias("k"))
    name = F.when(F.col("k") == 0, F.concat(F.lit("A"), "s_suppkey")).when(F.col("k") == 1, F.concat(F.lit("b"), "s_suppkey")).otherwise("c")
    files = s.where("k < 3").select(F.concat_ws("/", F.lit("g"), "learner_id", F.concat(name, F.lit(".TextGrid"))).alias("path"), F.when(F.col("k") < 2, name).otherwise(F.concat(F.lit("other"), "s_suppkey")).alias("stem"))
    items = s.withColumns({"audio_stem": F.concat(F.lit("a"), "s_suppkey"), "textgrid": F.when(F.col("k") == 1, F.concat(F.lit("x/B"), "s_suppkey", F.lit(".TextGrid"))).when(F.col("k") == 2, "c.TextGrid")})
    return link.resolve_annotations(items, files, "g").select("s_suppkey", "annotation_path")


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'g/s' || s_suppkey || '/w' || s_suppkey || '.TextGrid' WHEN 1 THEN 'g/s' || s_suppkey || '/w' || s_suppkey || '_1.TextGrid' WHEN 2 THEN 'g/t/w' || s_suppkey || '.TextGrid' END AS annotation_path FROM supplier""")
def recording_annotation(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).alias("k"))
    stem = F.concat(F.lit("w"), "s_suppkey")
    mine = F.concat(F.lit("s"), "s_suppkey")
    f = s.select("s_suppkey", F.explode(F.when(F.col("k") == 0, F.array(F.struct(mine.alias("folder"), stem.alias("stem")), F.struct(mine.alias("folder"), F.concat(stem, F.lit("_0")).alias("stem")))).when(F.col("k") == 1, F.array(F.struct(mine.alias("folder"), F.concat(stem, F.lit("_2")).alias("stem")), F.struct(mine.alias("folder"), F.concat(stem, F.lit("_1")).alias("stem")))).when(F.col("k") == 2, F.array(F.struct(F.lit("t").alias("folder"), stem.alias("stem"))))).alias("f")).select("f.*")
    files = f.select(F.concat(F.lit("g/"), "folder", F.lit("/"), "stem", F.lit(".TextGrid")).alias("path"), "folder", "stem", F.lit("TextGrid").alias("ext"))
    recordings = s.select("s_suppkey", stem.alias("wav"), mine.alias("speaker"), stem.alias("stem"))
    return link.annotation_for_recording(recordings, files).select("s_suppkey", "annotation_path")


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '/abs/' || s_suppkey || '.wav' WHEN 1 THEN 'root/in/' || s_suppkey || '.wav' ELSE 'root/' || s_suppkey || '/' || s_suppkey || '.wav' END AS audio_filepath FROM supplier WHERE s_suppkey % 4 < 3""")
def resolve_audio(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    file = F.concat("s_suppkey", F.lit(".wav"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("ord"), F.col("s_suppkey").cast("string").alias("learner_id"), F.when(k == 0, F.concat(F.lit("/abs/"), file)).otherwise(F.concat(F.lit("in/"), file)).alias("audio_file"))
    listing = s.select(F.when(k == 0, F.col("audio_file")).when(k == 1, F.concat(F.lit("root/"), "audio_file")).when(k == 2, F.concat(F.lit("root/"), "learner_id", F.lit("/"), file)).alias("path")).where("path is not null")
    return link.resolve_audio(s, listing, "root/").select("s_suppkey", "audio_filepath")


# -- segments


def _segmented(spark, sf_dir):
    d = table(spark, sf_dir, "conversations")
    name = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn", F.lit(".wav"))).when(F.col("turn") == 1, F.concat(F.lit("c"), "conv_id", F.lit(".wav"))).otherwise(F.concat(F.lit("c"), "conv_id", F.lit("_segment"), F.col("turn") + 8, F.lit(".wav")))
    return d.select("conv_id", "turn", name.alias("audio_file"), F.col("role").alias("canonical_text"), F.col("text").alias("ref_text"), F.when(F.col("turn") % 3 == 1, " ").otherwise(F.col("role")).alias("hyp_text"), (F.col("conv_id") * 10_000 + F.col("turn")).alias("ord"))


@query(r"""WITH s AS (SELECT *, regexp_replace(regexp_replace(text, '^[\s\x0B\p{Z}]+', ''), '[\s\x0B\p{Z}]+$', '') AS t, CASE WHEN turn % 3 = 1 THEN '' ELSE role END AS h FROM conversations),
m AS (SELECT conv_id, bool_or(turn <> 1) AS merged, 'c' || conv_id || '.wav' AS audio_file, string_agg(t, ' ' ORDER BY turn = 1, turn) AS ref_text, trim(string_agg(h, ' ' ORDER BY turn = 1, turn)) AS hyp_text, arg_min(role, CASE WHEN turn = 1 THEN 1000 ELSE turn END) AS canonical_text FROM s WHERE conv_id % 5 <> 0 GROUP BY conv_id)
SELECT conv_id, audio_file, canonical_text, trim(ref_text) AS ref_text, hyp_text FROM m WHERE merged
UNION ALL SELECT conv_id, 'c' || conv_id || '.wav', role, text, CASE WHEN turn % 3 = 1 THEN ' ' ELSE role END FROM conversations JOIN m USING (conv_id) WHERE NOT merged
UNION ALL SELECT conv_id, 'c' || conv_id || '_' || turn || '.wav', role, text, CASE WHEN turn % 3 = 1 THEN ' ' ELSE role END FROM conversations WHERE conv_id % 5 = 0""")
def segment_merge(spark, sf_dir):
    return segments.merge_segments(_segmented(spark, sf_dir)).select("conv_id", "audio_file", "canonical_text", "ref_text", "hyp_text")


@query(r"""WITH s AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'c' || conv_id || '_' || turn || '.wav' ELSE 'c' || conv_id || '.wav' END AS g, CASE WHEN conv_id % 5 = 0 OR turn = 1 THEN 0 ELSE turn + 8 END AS o,
  regexp_replace(regexp_replace(text, '^[\s\x0B\p{Z}]+', ''), '[\s\x0B\p{Z}]+$', '') AS t FROM conversations),
a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o, turn) AS n, first_value(role) OVER (PARTITION BY g ORDER BY o, turn) AS can, string_agg(nullif(t, ''), ' ') OVER (PARTITION BY g ORDER BY o, turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS r,
  string_agg(CASE WHEN turn % 3 <> 1 THEN role END, ' ') OVER (PARTITION BY g ORDER BY o, turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS h FROM s)
SELECT conv_id, turn, n = 1 AS is_first, CASE WHEN n = 1 THEN can END AS CAN_FG, CASE WHEN n = 1 THEN coalesce(r, '') END AS REF_FG, CASE WHEN n = 1 THEN coalesce(h, '') END AS HYP_FG FROM a""")
def segment_groups(spark, sf_dir):
    return segments.group_texts(_segmented(spark, sf_dir)).select("conv_id", "turn", "is_first", "CAN_FG", "REF_FG", "HYP_FG")


@query("""WITH i AS (SELECT 's_' || user_id || '_x_y' AS stem, event_id AS idx, event_id % 50 AS a, event_id % 50 + value / 10 - 3 AS b FROM events),
p AS (SELECT *, count(*) OVER (PARTITION BY stem) AS n FROM i WHERE b > a),
u AS (SELECT *, greatest(0, CAST(round_even(a * 8000, 0) AS BIGINT)) AS f, least(300000, CAST(round_even(b * 8000, 0) AS BIGINT)) AS l FROM p)
SELECT idx, CASE WHEN n = 1 THEN 'out/' || 's_' || split_part(stem, '_', 2) || '_x' || '/' || stem || '.wav' ELSE 'out/s_' || split_part(stem, '_', 2) || '_x/' || stem || '_segment' || row_number() OVER (PARTITION BY stem ORDER BY idx) || '.wav' END AS audio_filepath, f AS first_sample, l AS last_sample, round(b - a, 3) AS duration FROM u WHERE l > f""")
def cut_segments(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    wav = F.concat(F.lit("in/s_"), "user_id", F.lit("_x_y.wav"))
    start = (F.col("event_id") % 50).cast("double")
    intervals = e.select(wav.alias("wav"), F.col("event_id").alias("idx"), start.alias("xmin"), (start + F.col("value") / 10 - 3).alias("xmax"), F.col("event_type").alias("text"))
    records = e.select(wav.alias("wav"), F.lit(300_000).cast("long").alias("samples")).distinct()
    return segments.cut(records, intervals, "out", 8000).select("idx", "audio_filepath", "first_sample", "last_sample", "duration")


@query("""SELECT CASE WHEN doc_id % 7 = 0 THEN 'missing_audio' WHEN quality IS NULL THEN 'missing_annotation' WHEN quality = 0 THEN 'no_interval' ELSE 'used' END AS reason, count(*) AS n
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY 1""")
def skip_reasons(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("wav"))
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("wav"), F.lit(0.0).alias("xmin"), F.col("quality").cast("double").alias("xmax"))
    return segments.skip_reasons(d, d.where("wav % 7 <> 0"), marks, marks)


def _grids(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    block = F.concat(F.lit("        intervals ["), "event_id", F.lit("]:\n            xmin = "), F.col("event_id").cast("string"), F.lit("\n            xmax = "), (F.col("event_id") + 1).cast("string"), F.lit('\n            text = "'), "event_type", F.lit("\n  <um> "), F.lit('two ""quoted"" words" \n'))
    rows = F.sort_array(F.collect_list(F.struct("event_id", block.alias("b"))))
    head = F.concat(F.lit('File type = "ooTextFile"\nxmin = 0\nxmax = 99\nitem []:\n    item [1]:\n        class = "IntervalTier"\n        name = "Child"\n        xmin = 0\n        xmax = 99\n'))
    return e.groupBy("user_id").agg(F.concat(head, F.array_join(F.transform(rows, lambda r: r["b"]), "")).alias("content"))


@query("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, 'Child' AS tier, CAST(event_id AS DOUBLE) AS xmin, CAST(event_id + 1 AS DOUBLE) AS xmax, event_type || chr(10) || '<um> two "quoted" words' AS text FROM events""")
def textgrid_intervals(spark, sf_dir):
    return textgrid.explode_intervals(_grids(spark, sf_dir))


@query("""SELECT user_id, string_agg(event_type || ' two "quoted" words', ' ' ORDER BY event_id) AS ref_text FROM events GROUP BY user_id""")
def tier_text(spark, sf_dir):
    return textgrid.tier_text(textgrid.explode_intervals(_grids(spark, sf_dir)), "user_id")


# -- alignment and scores of readings


@query(f"WITH {SQL_READINGS} SELECT audio_file, {sql_tags('can', 'ref')} AS tags FROM readings")
def tags_of_readings(spark, sf_dir):
    return standins.readings(spark, sf_dir).select("audio_file", tag_sequence(F.col("canonical_text"), F.col("ref_text"), insert=INSERT).alias("tags"))


@query("SELECT p_partkey, " + sql_tags("string_split(p_name || ' ' || p_type, ' ')", "string_split(p_type || ' ' || p_name || ' ' || p_brand, ' ')") + " AS tags FROM part")
def tags_in_sql(spark, sf_dir):
    words = lambda *c: F.split(F.concat_ws(" ", *c), " ")
    return table(spark, sf_dir, "part").select("p_partkey", words("p_name", "p_type").alias("a"), words("p_type", "p_name", "p_brand").alias("b")).select("p_partkey", tags_sql(F.col("a"), F.col("b")).alias("tags"))


_COUNT = lambda c, k: f"len({c}) - len(replace({c}, '{k}', ''))"


@query(f"""WITH {SQL_READINGS}, t AS (SELECT audio_file, {sql_tags('can', 'ref')} AS a, {sql_tags('can', 'hyp')} AS b FROM readings),
w AS (SELECT audio_file, string_split_regex(a, '') AS x, string_split_regex(b, '') AS y, a FROM t), m AS (SELECT audio_file, a, {sql_tags('x', 'y')} AS m FROM w)
SELECT audio_file, CAST({_COUNT('m', 's')} AS BIGINT) AS S_mer, CAST({_COUNT('m', 'd')} AS BIGINT) AS D_mer, CAST({_COUNT('m', 'i')} AS BIGINT) AS I_mer, CAST({_COUNT('m', 'c')} AS BIGINT) AS C_mer, CAST(len(a) AS BIGINT) AS N_mer FROM m""")
def mistake_counts(spark, sf_dir):
    s = scores(F.col("canonical_text"), F.col("ref_text"), F.col("hyp_text"))
    return standins.readings(spark, sf_dir).select("audio_file", s.alias("s")).select("audio_file", *[F.col(f"s.{k}_mer").alias(f"{k}_mer") for k in "SDICN"])


@query(f"WITH {SQL_READINGS} SELECT audio_file, CAST({sql_distance('ref', 'hyp')} AS BIGINT) AS errors, CAST(len(ref) AS BIGINT) AS n FROM readings")
def word_errors(spark, sf_dir):
    d = score.error_rows(standins.readings(spark, sf_dir))
    return d.select("audio_file", (F.col("S_ref_hyp") + F.col("D_ref_hyp") + F.col("I_ref_hyp")).alias("errors"), F.col("N_ref_hyp").alias("n"))


@query(f"""WITH {SQL_READINGS}, e AS (SELECT category, CAST({sql_distance('ref', 'hyp')} AS BIGINT) AS e, len(ref) AS n FROM readings WHERE category IS NOT NULL)
SELECT category AS audio_type, count(*) AS n, 100.0 * sum(e) / sum(n) AS rate_ref_hyp FROM e GROUP BY GROUPING SETS ((category), ())""")
def wer_by_category(spark, sf_dir):
    """The headline question: word error rate of each task and overall."""
    return summary.error_rates(score.error_rows(standins.readings(spark, sf_dir)), prefixes=("ref_hyp",))


def _sql_counts(edits: str, letters: str, suffix: str) -> list[str]:
    return [f"CAST({_COUNT(edits, k.lower())} AS BIGINT) AS {k}_{suffix}" for k in letters]


def _sql_fine() -> list[tuple[str, str]]:
    """(column, SQL) of hits, false and missed mistakes by kind, from the steps z of aligned tags p and t."""
    out = []
    for k, name in (("s", "sub"), ("i", "ins"), ("d", "del")):
        tp = f"len(list_filter(z, lambda x: x.p = '{k}' AND x.t = '{k}'))"
        out += [(f"{name}_tp", tp), (f"{name}_fp", f"({_COUNT('p', k)} - {tp})"), (f"{name}_fn", f"({_COUNT('t', k)} - {tp})")]
    return out


_SQL_STEPS = "list_transform(range(1, len(m) + 1), lambda k: {'p': CASE WHEN m[k] = 'd' THEN '-' ELSE p[len(replace(m[:k], 'd', ''))] END, 't': CASE WHEN m[k] = 'i' THEN '-' ELSE t[len(replace(m[:k], 'i', ''))] END})"


def _sql_unit(pairs: tuple[tuple[str, str, str], ...], source: str) -> str:
    """CTEs u and e: the edits of each (name, truth, test) pair of word lists as columns of e."""
    middles = ", ".join(f"{x} AS {n}_{c}" for n, a, b in pairs for c, x in zip("xy", sql_middles(a, b)))
    edits = ", ".join(f"CASE WHEN len({a}) = 0 THEN repeat('i', len({b})) ELSE {sql_edits(f'{n}_x', f'{n}_y')} END AS {n}" for n, a, b in pairs)
    return f"u AS (SELECT *, {middles} FROM {source}), e AS (SELECT *, {edits} FROM u)"


def _sql_score_rows() -> str:
    """Whole texts as the readings have them, unit-cost counts, tags, and what the alignment of the two tag sequences says."""
    right = lambda n, c: f"CAST(len({n}) - ({_COUNT(c, 's')}) - ({_COUNT(c, 'd')}) AS BIGINT)"
    return f"""WITH {SQL_READINGS}, t AS (SELECT *, {sql_tags('can', 'ref')} AS t, {sql_tags('can', 'hyp')} AS p FROM readings WHERE category IS NOT NULL),
{_sql_unit((('rh', 'ref', 'hyp'), ('cr', 'can', 'ref'), ('ch', 'can', 'hyp')), 't')},
l AS (SELECT *, string_split_regex(t, '') AS t_list, string_split_regex(p, '') AS p_list FROM e), m AS (SELECT *, {sql_tags('t_list', 'p_list')} AS m FROM l), z AS (SELECT *, {_SQL_STEPS} AS z FROM m)
SELECT learner_id, audio_file, category AS audio_type, array_to_string(can, ' ') AS CAN, array_to_string(ref, ' ') AS REF, array_to_string(hyp, ' ') AS HYP,
  {', '.join(_sql_counts('rh', 'SDI', 'ref_hyp'))}, {right('ref', 'rh')} AS C_ref_hyp, CAST(len(ref) AS BIGINT) AS N_ref_hyp, {right('can', 'cr')} AS C_can_ref, {right('can', 'ch')} AS C_can_hyp,
  {', '.join(_sql_counts('m', 'SDIC', 'mer'))}, CAST(len(t) AS BIGINT) AS N_mer, {', '.join(f'CAST({e} AS BIGINT) AS {c}' for c, e in _sql_fine())}, t AS tags_can_ref, p AS tags_can_hyp, m AS tags_mer FROM z"""


SQL["score_rows"] = _sql_score_rows()


@query()
def score_rows(spark, sf_dir):
    return score.score_rows(standins.readings(spark, sf_dir), with_tags=True)


@query()
def score_rows_v1(spark, sf_dir):
    return score.with_advanced(score.score_rows_v1(standins.readings(spark, sf_dir)))


def _sql_places(tags: str) -> str:
    """The errors of a tag sequence at their places; none without a canonical text."""
    upto = f"{tags}[:k - 1]"
    before = lambda x: f"k - 1 - (len({upto}) - len(replace({upto}, '{x}', '')))"
    return f"CASE WHEN len(can) = 0 THEN [] ELSE list_transform(list_filter(range(1, len({tags}) + 1), lambda k: {tags}[k] <> 'c'), lambda k: {tags}[k] || CASE WHEN {tags}[k] = 'i' THEN {before('d')} ELSE {before('i')} END) END"


def _sql_placed_counts() -> list[tuple[str, str]]:
    """(column, SQL) of hits, false and missed errors by kind, from those of REF in a and of HYP in b."""
    out = []
    for k in "SDI":
        a, b = (f"list_distinct(list_filter({c}, lambda x: x[1] = '{k.lower()}'))" for c in "ab")
        tp = f"len(list_intersect({a}, {b}))"
        out += [(f"{k}_TP", f"CAST({tp} AS BIGINT)"), (f"{k}_FP", f"CAST(len({b}) - {tp} AS BIGINT)"), (f"{k}_FN", f"CAST(len({a}) - {tp} AS BIGINT)")]
    return out


def _sql_placed_errors() -> str:
    return f"""WITH {SQL_READINGS}, t AS (SELECT *, {sql_tags('can', 'ref')} AS t, {sql_tags('can', 'hyp')} AS p FROM readings),
e AS (SELECT audio_file, {_sql_places('t')} AS a, {_sql_places('p')} AS b FROM t) SELECT audio_file, CAST(len(a) AS INT) AS n_errors, {', '.join(f'{x} AS {c}' for c, x in _sql_placed_counts())} FROM e"""


SQL["placed_errors"] = _sql_placed_errors()


@query()
def placed_errors(spark, sf_dir):
    d = standins.readings(spark, sf_dir)
    return d.select("audio_file", errors_at(F.col("canonical_text"), F.col("ref_text")).alias("e"), placed_scores(F.col("canonical_text"), F.col("ref_text"), F.col("hyp_text")).alias("p")).select("audio_file", F.size("e").alias("n_errors"), "p.*")


def _sql_score_rows_v1() -> str:
    """Each reading is a recording of one segment; REF is the truth for CAN, and texts go by two normalisers."""
    words = lambda c: rf"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(array_to_string({c}, ' ')), '[!-/:-@\[-`{{-~]', ' ', 'g'), '[\s\x0B\p{{Z}}]+', ' ', 'g')), ' '), lambda x: x <> '')"
    text = lambda c: f"array_to_string({c}, ' ')"
    per = lambda x, y: f"({x}) / CAST(nullif({y}, 0) AS DOUBLE)"

    def prf(tp: str, fp: str, fn: str, names: tuple[str, str, str], zero: bool) -> list[str]:
        fill = (lambda x: f"coalesce({x}, 0.0)") if zero else (lambda x: f"({x})")
        p, r = fill(per(tp, f"{tp} + {fp}")), fill(per(tp, f"{tp} + {fn}"))
        return [f"{p} AS {names[0]}", f"{r} AS {names[1]}", f"{fill(f'2 * {p} * {r} / nullif({p} + {r}, 0)')} AS {names[2]}"]

    counts = []
    for pair, n, c in (("can_ref", "ref", "cr"), ("can_hyp", "can", "ch"), ("ref_hyp", "ref", "rh")):
        counts += [*_sql_counts(c, "SDI", pair), f"CAST(len({n}) AS BIGINT) AS N_{pair}", f"CAST(len({n}) - ({_COUNT(c, 's')}) - ({_COUNT(c, 'd')}) AS BIGINT) AS C_{pair}"]
    fine = dict(_sql_fine())
    kinds = []
    for k, name in (("sub", "S"), ("ins", "I"), ("del", "D")):
        kinds += prf(*[f"{k}_{x}" for x in ("tp", "fp", "fn")], tuple(f"fine_{name}_{m}" for m in ("Precision", "Recall", "F1")), True)
    kinds += prf(*[f"(sub_{x} + ins_{x} + del_{x})" for x in ("tp", "fp", "fn")], ("Mistakes_Precision", "Mistakes_Recall", "Mistakes_F1"), True)
    for k in "SDI":
        kinds += prf(*[f"{k}_{x}" for x in ("TP", "FP", "FN")], tuple(f"phono_{k}_{m}" for m in ("Precision", "Recall", "F1")), False)
    rates_ = []
    for pair in ("can_ref", "can_hyp", "ref_hyp"):
        rates_ += [f"CASE WHEN N_{pair} = 0 AND I_{pair} > 0 THEN CAST('inf' AS DOUBLE) ELSE {per(f'100.0 * (S_{pair} + D_{pair} + I_{pair})', f'N_{pair}')} END AS WER_{pair}", f"{per(f'C_{pair}', f'N_{pair}')} * 100.0 AS ACC_{pair}"]
    placed = dict(_sql_placed_counts())
    return f"""WITH {SQL_READINGS}, w AS (SELECT *, {', '.join(f'{words(c)} AS {c}_w' for c in ('can', 'ref', 'hyp'))} FROM readings),
g AS (SELECT *, {sql_tags('can_w', 'ref_w')} AS t, {sql_tags('can_w', 'hyp_w')} AS p, {sql_tags('can', 'ref')} AS t_raw, {sql_tags('can', 'hyp')} AS p_raw FROM w),
{_sql_unit((('rh', 'ref', 'hyp'), ('cr', 'ref', 'can'), ('ch', 'can', 'hyp')), 'g')},
l AS (SELECT *, string_split_regex(t, '') AS t_list, string_split_regex(p, '') AS p_list, {_sql_places('t_raw')} AS a, {_sql_places('p_raw')} AS b FROM e),
m AS (SELECT *, {sql_tags('t_list', 'p_list')} AS m FROM l), z AS (SELECT *, {_SQL_STEPS} AS z FROM m),
c AS (SELECT learner_id, audio_file, kind AS audio_type, ord, {text('can')} AS CAN, {text('ref')} AS REF, {text('hyp')} AS HYP, len(hyp) > 0 AS has_hyp, {', '.join(counts)},
  {', '.join(f'{x} AS {k}' for k, x in fine.items())}, {', '.join(f'{x} AS {k}' for k, x in placed.items())}, {per('len(m) - (' + _COUNT('m', 'c') + ')', 'len(t)')} AS MER FROM z),
r AS (SELECT *, {', '.join(rates_)} FROM c)
SELECT learner_id, audio_file, audio_type, CAN AS canonical_text, REF AS ref_text, HYP AS hyp_text, ord, CAN AS CAN_FG, REF AS REF_FG, HYP AS HYP_FG, CAN, REF, HYP, has_hyp,
  {', '.join(f'{x}_{pair}' for pair in ('can_ref', 'can_hyp', 'ref_hyp') for x in ('WER', 'ACC', 'S', 'D', 'I', 'N', 'C'))},
  C_can_ref AS EGRA_COR, ACC_can_ref AS EGRA_ACC, C_can_hyp AS ASR_EGRA_COR, ACC_can_hyp AS ASR_EGRA_ACC, abs(C_can_ref - C_can_hyp) AS MAE_EGRA_COR, WER_ref_hyp AS ASR_WER,
  ACC_can_ref / 100.0 AS ACC_can_ref_norm_for_mae, ACC_can_hyp / 100.0 AS ACC_can_hyp_norm_for_mae, abs(ACC_can_ref / 100.0 - ACC_can_hyp / 100.0) AS MAE_EGRA_ACC, abs(ACC_can_ref - (SELECT avg(ACC_can_ref) FROM r)) AS Bias_Baseline_MAE,
  MER, {', '.join(placed)}, {', '.join(kinds)} FROM r"""


SQL["score_rows_v1"] = _sql_score_rows_v1()


# -- aggregates of scored rows

_R = lambda p: f"100.0 * (sum(S_{p}) + sum(D_{p}) + sum(I_{p})) / nullif(sum(N_{p}), 0)"
_ACC = lambda p: f"100.0 * (sum(C_{p}) / nullif(CAST(sum(N_{p}) AS DOUBLE), 0))"
_SUMS = lambda p: ", ".join(f"CAST(coalesce(sum({k}_{p}), 0) AS BIGINT) AS {k}_{p}" for k in "SDICN")


@query(f"WITH {SQL_SCORED} SELECT category AS audio_type, count(*) AS n, {_R('ref_hyp')} AS rate_ref_hyp, {_R('mer')} AS rate_mer FROM scored GROUP BY GROUPING SETS ((category), ())")
def error_rates(spark, sf_dir):
    return summary.error_rates(standins.scored(spark, sf_dir, True))


@query(f"WITH {SQL_SCORED} SELECT macro_category, {_R('can_ref')} AS WER_can_ref, {_ACC('can_ref')} AS ACC_can_ref, {_SUMS('can_ref')} FROM scored GROUP BY 1")
def pair_summary(spark, sf_dir):
    return summary.pair_summary(standins.scored(spark, sf_dir), "can_ref", ["macro_category"])


@query(f"WITH {SQL_SCORED} SELECT CASE WHEN grouping(learner_id) = 1 THEN '__GLOBAL__' ELSE learner_id END AS learner_id, {_R('can_hyp')} AS WER_can_hyp, {_ACC('can_hyp')} AS ACC_can_hyp, {_SUMS('can_hyp')} FROM scored GROUP BY GROUPING SETS ((learner_id), ())")
def speaker_summary(spark, sf_dir):
    return summary.speaker_summary(standins.scored(spark, sf_dir), "can_hyp")


@query(f"WITH {SQL_SCORED} SELECT learner_id, macro_category, {_R('ref_hyp')} AS WER_ref_hyp, {_ACC('ref_hyp')} AS ACC_ref_hyp, {_SUMS('ref_hyp')} FROM scored GROUP BY 1, 2")
def macro_summary(spark, sf_dir):
    return summary.macro_summary(standins.scored(spark, sf_dir), "ref_hyp")


@query(f"WITH {SQL_SCORED} SELECT learner_id, macro_category, sub_category, {_R('ref_hyp')} AS WER_ref_hyp, {_ACC('ref_hyp')} AS ACC_ref_hyp, {_SUMS('ref_hyp')} FROM scored GROUP BY 1, 2, 3")
def subcategory_summary(spark, sf_dir):
    d = standins.scored(spark, sf_dir).drop("macro_category", "sub_category")
    return summary.macro_summary(score.with_categories(d), "ref_hyp", True)


def _sql_placed() -> str:
    out = []
    for k in "SDI":
        tp, fp, fn = (f"CAST(sum({k}_{x}) AS DOUBLE)" for x in ("TP", "FP", "FN"))
        p, r = f"({tp} / nullif({tp} + {fp}, 0))", f"({tp} / nullif({tp} + {fn}, 0))"
        out += [f"CAST(sum({k}_{x}) AS BIGINT) AS {k}_{x}" for x in ("TP", "FP", "FN")] + [f"{p} AS {k}_Precision", f"{r} AS {k}_Recall", f"2 * {p} * {r} / nullif({p} + {r}, 0) AS {k}_F1"]
    return ", ".join(out)


@query(f"WITH {SQL_SCORED} SELECT learner_id, {_sql_placed()} FROM scored GROUP BY 1")
def placed_summary(spark, sf_dir):
    return summary.placed_summary(standins.scored(spark, sf_dir), ["learner_id"])


@query(f"WITH {SQL_SCORED} SELECT macro_category, sub_category, CASE WHEN grouping(macro_category) = 1 THEN 'overall' WHEN grouping(sub_category) = 1 THEN 'macro' ELSE 'sub' END AS grain, {_sql_placed()} FROM scored GROUP BY ROLLUP (macro_category, sub_category)")
def placed_rollup(spark, sf_dir):
    return summary.placed_by_category(standins.scored(spark, sf_dir))


def _sql_category(where: str = "") -> str:
    graded, alone = (f"category IN ({', '.join(repr(c) for c in cs)})" for cs in (summary.GRADED, summary.ISOLATED))
    cols = [f"{_R('ref_hyp')} AS wer", f"{_R('mer')} AS mer", f"CASE WHEN {graded} THEN corr(C_can_hyp, C_can_ref) END AS corr"]
    for k in ("sub", "ins", "del"):
        tp, fp, fn = (f"CAST(sum({k}_{x}) AS DOUBLE)" for x in ("tp", "fp", "fn"))
        p, r = f"({tp} / ({tp} + {fp}))", f"({tp} / ({tp} + {fn}))"
        cols += [f"CASE WHEN {graded} THEN 100 * (2 * {p} * {r} / ({p} + {r})) END AS {k}_f1", f"CASE WHEN {graded} THEN 100 * {p} END AS {k}_precision", f"CASE WHEN {graded} THEN 100 * {r} END AS {k}_recall"]
    cols += [f"CASE WHEN {graded} THEN regr_slope(C_can_hyp, C_can_ref) END AS slope", f"CASE WHEN {graded} THEN regr_intercept(C_can_hyp, C_can_ref) END AS intercept"]
    a, b = "C_can_ref = 0", "C_can_hyp = 0"
    tp, tn, fp, fn = (f"CAST(count(*) FILTER ({x} AND {y}) AS DOUBLE)" for x, y in ((a, b), (f"NOT {a}", f"NOT {b}"), (f"NOT {a}", b), (a, f"NOT {b}")))
    p, r = f"({tp} / ({tp} + {fp}))", f"({tp} / ({tp} + {fn}))"
    cols += [f"CASE WHEN {alone} THEN 100 * (({tp} + {tn}) / ({tp} + {tn} + {fp} + {fn})) END AS accuracy", f"CASE WHEN {alone} THEN 100 * {p} END AS precision", f"CASE WHEN {alone} THEN 100 * {r} END AS recall", f"CASE WHEN {alone} THEN 100 * (2 * {p} * {r} / ({p} + {r})) END AS f1"]
    return f"""WITH {SQL_SCORED}, g AS (SELECT CASE WHEN grouping(category) = 1 THEN 'global' ELSE category END AS category, count(*) AS n, {', '.join(cols)} FROM scored {where} GROUP BY GROUPING SETS ((category), ()))
SELECT c.category, coalesce(n, 0) AS n, * EXCLUDE (category, n) FROM (SELECT unnest({_LIST(('global', *paths.CATEGORIES))}) AS category) c LEFT JOIN g ON c.category = g.category"""


SQL["category_scores"] = _sql_category().replace("SELECT c.category, coalesce(n, 0) AS n, * EXCLUDE (category, n) FROM", "SELECT c.category, coalesce(n, 0) AS n, g.* EXCLUDE (category, n) FROM")
SQL["dashboard_filtered"] = _sql_category("WHERE region IN ('A', 'N') AND gender = 'F'").replace("SELECT c.category, coalesce(n, 0) AS n, * EXCLUDE (category, n) FROM", "SELECT c.category, coalesce(n, 0) AS n, g.* EXCLUDE (category, n) FROM")


@query()
def category_scores(spark, sf_dir):
    return summary.category_scores(standins.scored(spark, sf_dir, True), detailed=True)


@query()
def dashboard_filtered(spark, sf_dir):
    return summary.dashboard(standins.scored(spark, sf_dir, True), regions=["A", "N"], genders=["F"], detailed=True)


@query(f"WITH {SQL_SCORED} SELECT count(*) AS rows, count(DISTINCT learner_id) AS learners FROM scored")
def overview(spark, sf_dir):
    return summary.overview(standins.scored(spark, sf_dir))


@query(f"WITH {SQL_SCORED} SELECT DISTINCT region FROM scored")
def filter_options(spark, sf_dir):
    return summary.options(standins.scored(spark, sf_dir), "region")


@query(f"WITH {SQL_SCORED} SELECT audio_type, C_can_ref AS x, C_can_hyp AS y, count(*) AS n FROM scored WHERE C_can_ref IS NOT NULL AND C_can_hyp IS NOT NULL GROUP BY 1, 2, 3")
def scatter_points(spark, sf_dir):
    return sinks.scatter_points(standins.scored(spark, sf_dir))


def _v1(spark, sf_dir):
    d = standins.scored(spark, sf_dir)
    return d.withColumns({"MAE_EGRA_COR": F.abs(F.col("C_can_ref") - F.col("C_can_hyp")).cast("double"), "WER_ref_hyp": rates.wer(*[F.col(f"{k}_ref_hyp") for k in "SDIN"]), "MER": rates.ratio(F.col("S_mer") + F.col("D_mer"), F.col("N_mer"))})


_SQL_V1 = f"{SQL_SCORED}, v AS (SELECT *, CAST(abs(C_can_ref - C_can_hyp) AS DOUBLE) AS MAE_EGRA_COR, CASE WHEN N_ref_hyp = 0 AND I_ref_hyp > 0 THEN CAST('inf' AS DOUBLE) ELSE 100.0 * (S_ref_hyp + D_ref_hyp + I_ref_hyp) / nullif(N_ref_hyp, 0) END AS WER_ref_hyp, (S_mer + D_mer) / nullif(CAST(N_mer AS DOUBLE), 0) AS MER FROM scored)"


def _sql_tasks() -> str:
    def prf(tp, fp, fn, names):
        p, r = f"coalesce({tp} / nullif({tp} + {fp}, 0), 0)", f"coalesce({tp} / nullif({tp} + {fn}, 0), 0)"
        return [f"{p} AS {names[0]}", f"{r} AS {names[1]}", f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0) AS {names[2]}"]

    d = lambda e: f"CAST({e} AS DOUBLE)"
    cols = ["avg(CASE WHEN isfinite(WER_ref_hyp) THEN WER_ref_hyp END) AS finite_wer", "corr(C_ref_hyp, C_can_ref) AS r_correlation", "avg(MAE_EGRA_COR) AS MAE_correct_counts", "avg(MER) AS MER"]
    for k, n in (("S", "subs"), ("D", "del"), ("I", "insert")):
        cols += prf(*[d(f"sum({k}_{x})") for x in ("TP", "FP", "FN")], [f"{n}_{m}" for m in ("prec", "r", "f1")])
    cols += prf(*[d(f"sum(S_{x}) + sum(D_{x}) + sum(I_{x})") for x in ("TP", "FP", "FN")], [f"mistakes_{m}" for m in ("prec", "r", "f1")])
    wrong = "(coalesce(S_can_ref, 0) + coalesce(D_can_ref, 0) + coalesce(I_can_ref, 0)) > 0"
    p = f"(count(*) FILTER ({wrong}) / CAST(count(*) AS DOUBLE))"
    cols += ["0.0::DOUBLE AS baseline_none_prec", "0.0::DOUBLE AS baseline_none_r", "0.0::DOUBLE AS baseline_none_f1", f"{p} AS baseline_all_prec", f"CASE WHEN {p} > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS baseline_all_r", f"2 * {p} / ({p} + 1) AS baseline_all_f1"]
    return f"WITH {_SQL_V1} SELECT macro_category, sub_category, count(*) AS n, {', '.join(cols)} FROM v GROUP BY 1, 2"


SQL["task_blocks_v1"] = _sql_tasks()


@query()
def task_blocks_v1(spark, sf_dir):
    d = _v1(spark, sf_dir)
    finite = d.where("N_ref_hyp > 0").groupBy("macro_category", "sub_category").agg(rates.mean("WER_ref_hyp").alias("finite_wer"))
    return summary.task_blocks_v1(d).drop("mean_wer_ref_hyp").join(finite, ["macro_category", "sub_category"])


@query("""WITH a AS (SELECT *, o_totalprice / 5000.0 AS ACC_can_ref, (o_orderkey % 100) * 1.0::DOUBLE AS ACC_can_hyp FROM orders)
SELECT o_orderkey, abs(ACC_can_ref / 100.0 - ACC_can_hyp / 100.0) AS MAE_EGRA_ACC, abs(ACC_can_ref - (SELECT avg(ACC_can_ref) FROM a)) AS Bias_Baseline_MAE FROM a""")
def mae_bias_baseline(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 5000.0).alias("ACC_can_ref"), (F.col("o_orderkey") % 100).cast("double").alias("ACC_can_hyp"), *[F.lit("a").alias(c) for c in ("CAN", "REF", "HYP")])
    return score.with_advanced(o).select("o_orderkey", "MAE_EGRA_ACC", "Bias_Baseline_MAE")


@query(f"""WITH {_SQL_V1} SELECT CAST(sum(C_can_ref) AS BIGINT) AS "EGRA-COR", {_ACC('can_ref')} AS "EGRA-ACC", CAST(sum(C_can_hyp) AS BIGINT) AS "ASR-EGRA-COR", {_ACC('can_hyp')} AS "ASR-EGRA-ACC", avg(MAE_EGRA_COR) AS MAE_EGRA_COR, 100 * avg(price) AS MAE_EGRA_ACC, avg(price) AS Bias_Baseline_MAE,
  avg(MER) AS MER, avg(price) AS Mistakes_F1, {_R('ref_hyp')} AS ASR_WER, corr(C_can_ref, C_can_hyp) AS r_correlation FROM v""")
def global_v1(spark, sf_dir):
    return summary.global_v1(_v1(spark, sf_dir).withColumns({c: F.col("price") for c in ("MAE_EGRA_ACC", "Bias_Baseline_MAE", "Mistakes_F1")}))


@query("""SELECT count(*) AS n, (count(*) FILTER ((quality = 0) = (toxic = 1))) / CAST(count(*) AS DOUBLE) AS agreement,
  (coalesce(count(*) FILTER (quality = 0 AND toxic = 1) / nullif(CAST(count(*) FILTER (quality = 0) AS DOUBLE), 0), 0) + count(*) FILTER (quality = 1 AND toxic = 0) / CAST(count(*) FILTER (quality = 1) AS DOUBLE)) / 2 AS balanced,
  count(*) FILTER (quality = 0) / CAST(count(*) AS DOUBLE) AS all_prec FROM labels""")
def isolated_agreement(spark, sf_dir):
    wrong, said = F.col("quality") == 0, F.col("toxic") == 1
    cells = [F.count_if(wrong & said), F.count_if(~wrong & ~said), F.count_if(~wrong & said), F.count_if(wrong & ~said)]
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), rates.agreement(*cells).alias("agreement"), rates.balanced_agreement(*cells).alias("balanced"), summary.baselines(wrong)["all_prec"].alias("all_prec"))


@query("SELECT p_type AS kind, corr(p_retailprice, p_size) AS corr, regr_slope(p_retailprice, p_size) AS slope, regr_intercept(p_retailprice, p_size) AS intercept FROM part GROUP BY 1")
def correlation_and_line(spark, sf_dir):
    slope, intercept = rates.line(F.col("p_size"), F.col("p_retailprice"))
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("kind")).agg(rates.correlation(F.col("p_retailprice"), F.col("p_size")).alias("corr"), slope.alias("slope"), intercept.alias("intercept"))


@query("SELECT CAST(sum(levenshtein(p_name, lower(p_type))) AS BIGINT) AS errors, CAST(sum(len(p_name)) AS BIGINT) AS length, sum(levenshtein(p_name, lower(p_type))) / CAST(sum(len(p_name)) AS DOUBLE) AS rate FROM part")
def character_error_rate(spark, sf_dir):
    return summary.corpus_error_rate(table(spark, sf_dir, "part").withColumn("kind", F.lower("p_type")), "p_name", "kind", characters=True)


@query(f"WITH {SQL_READINGS}, e AS (SELECT CAST({sql_distance('ref', 'hyp')} AS BIGINT) AS e, len(ref) AS n FROM readings) SELECT CAST(sum(e) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS length, sum(e) / CAST(sum(n) AS DOUBLE) AS rate FROM e")
def word_error_rate(spark, sf_dir):
    return summary.corpus_error_rate(standins.readings(spark, sf_dir), "ref_text", "hyp_text")


@query("SELECT o_orderstatus, tag, count(*) AS n FROM (SELECT o_orderstatus, unnest(string_split(replace(o_orderpriority, ' ', ''), '')) AS tag FROM orders) GROUP BY 1, 2")
def tag_frequencies(spark, sf_dir):
    return summary.tag_frequencies(table(spark, sf_dir, "orders").withColumn("tags", F.regexp_replace("o_orderpriority", " ", "")), "tags", "o_orderstatus")


@query(f"""WITH c AS (SELECT {SQL_CLEAN.format('text')} AS t FROM documents) SELECT count(*) AS total_lines, CAST(3 AS BIGINT) AS bad_json_skipped, count(*) - 3 - count(*) FILTER (t = '') AS written_lines, count(*) FILTER (t = '') AS dropped_empty_text FROM c""".replace("SELECT count(*) AS total_lines", "SELECT count(*) + 3 AS total_lines").replace("count(*) - 3 - count(*)", "count(*) - count(*)"))
def clean_stats(spark, sf_dir):
    return sinks.clean_stats(table(spark, sf_dir, "documents").withColumnRenamed("text", "ref_text"), bad=3)


@query("""SELECT conv_id, role, count(*) AS n, CAST(count(*) FILTER (trim(text) <> '') AS BIGINT) AS with_text FROM conversations GROUP BY 1, 2""")
def valid_texts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.count_if(~text.is_blank(F.col("text"))).alias("with_text"))


# -- sinks and sources, there and back


def _scratch(spark, what):
    """A folder for one table in shared storage; it goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/lectern-{what}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{path.toString()}/rows"


@query("SELECT 'c' || conv_id || '_' || turn || '.wav' AS audio_name, coalesce(text, '') AS hyp_text, coalesce(role, '') AS can_text FROM conversations")
def manifest_rows(spark, sf_dir):
    """A manifest written as JSON lines and read again."""
    path = _scratch(spark, "manifest")
    name = F.concat(F.lit("/in/c"), "conv_id", F.lit("_"), "turn", F.lit(".wav"))
    sinks.write_jsonl(table(spark, sf_dir, "conversations").select(name.alias("audio_filepath"), F.col("text").alias("pred_text"), F.col("role").alias("can_text")), path)
    return manifests.read_manifest(spark, path).select("audio_name", "hyp_text", "can_text")


@query(f"""WITH c AS (SELECT page_id, {SQL_CLEAN.format('html')} AS t FROM pages) SELECT 'p' || page_id AS audio_stem, md5(t) AS ref_text, 'u' AS can_text, FALSE AS manifest_hyp_present FROM c WHERE t <> ''""")
def cleaned_manifest(spark, sf_dir):
    """A manifest cleaned, written without empty texts, and read as rows to score."""
    path = _scratch(spark, "cleaned")
    name = F.concat(F.lit("/in/p"), "page_id", F.lit(".wav"))
    sinks.write_cleaned(table(spark, sf_dir, "pages").select(name.alias("audio_filepath"), F.col("html").alias("ref_text"), F.lit("U").alias("can_text"), F.lit("gone").alias("text")), path)
    return manifests.read_eval_manifest(spark, path).select("audio_stem", F.md5("ref_text").alias("ref_text"), "can_text", "manifest_hyp_present")


@query(f"WITH {SQL_SCORED} SELECT macro_category, count(*) AS n, CAST(sum(S_ref_hyp) AS BIGINT) AS S_ref_hyp, CAST(count(S_can_ref) AS BIGINT) AS compared, CAST(0 AS BIGINT) AS wards FROM scored GROUP BY 1")
def detailed_report(spark, sf_dir):
    """Scored rows written as the detailed report, with every column it has, and read again."""
    path = _scratch(spark, "report")
    sinks.write_csv(sinks.with_all_columns(standins.scored(spark, sf_dir)), path, single_file=False)
    back = spark.read.csv(path, header=True)
    assert tuple(back.columns[: len(sinks.REPORT_COLUMNS)]) == sinks.REPORT_COLUMNS
    return back.groupBy("macro_category").agg(F.count("*").alias("n"), F.sum("S_ref_hyp").cast("long").alias("S_ref_hyp"), F.count("S_can_ref").alias("compared"), F.count("ward").alias("wards"))
