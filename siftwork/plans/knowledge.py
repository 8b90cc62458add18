"""Queries on notes, beliefs, caches, budgets and verifiers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import routing as R
from ..functions import text as X
from ..operators import dedup, evidence, knowledge
from .fragments import FRAGMENTS, features, scored
from .registry import query, table
from .relational import _EDGES, SIMHASH, _edges, _nodes
from .samples import PATHS, code, pick, quoted, sql_code, sql_pick


def _r(x):
    return F.round(x, 6)


# ---- sources: definitions, imports, names in lines ----


def _any_sql(patterns) -> str:
    return "list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(content, {quoted('(?m)' + p.pattern)}, 1)" for p in patterns) + "))"


def sources(spark, sf):
    return code(table(spark, sf, "documents"))


@query("str6_extract_definitions", f"WITH {sql_code()} SELECT doc_id, unnest({_any_sql(evidence.DEFINED)}) AS symbol FROM code")
def str6(spark, sf):
    return sources(spark, sf).select("doc_id", F.explode(evidence.definitions("content")).alias("symbol"))


@query("str10_extract_imports", f"WITH {sql_code()} SELECT doc_id, unnest({_any_sql(evidence.IMPORTED)}) AS target FROM code")
def str10(spark, sf):
    return sources(spark, sf).select("doc_id", F.explode(evidence.imports("content")).alias("target"))


_LINES = f"{sql_code()}, l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS n FROM code)"


def lines(spark, sf):
    return sources(spark, sf).select("doc_id", F.posexplode(F.split("content", "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)


_LEFT = "regexp_extract(line, '^\\s*(?:const|let|var) ([^=]*)=\\s*require\\(', 1)"


@query("str7_require_lhs", f"WITH {_LINES}, x AS (SELECT doc_id, n, CASE WHEN regexp_matches({_LEFT}, '^\\s*\\{{.*\\}}') THEN trim(regexp_extract({_LEFT}, '^\\s*\\{{\\s*(?:,\\s*)*([^,:}}]*)[^}}]*\\}}', 1)) ELSE regexp_replace(trim({_LEFT}), '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g') END AS name FROM l) SELECT doc_id, n, name FROM x WHERE name <> ''")
def str7(spark, sf):
    return lines(spark, sf).select("doc_id", "n", R.required_name(F.col("line")).alias("name")).where("name is not null")


@query("str8_fn_name", f"WITH {_LINES}, x AS (SELECT doc_id, n, regexp_extract(line, '^.*?fn ([\\p{{L}}\\p{{N}}_]*)', 1) AS name FROM l) SELECT * FROM x WHERE name <> ''")
def str8(spark, sf):
    return lines(spark, sf).select("doc_id", "n", R.function_name(F.col("line")).alias("name")).where("name is not null")


_TYPES = ", ".join(f"nullif(regexp_extract(line, '^.*?{w} ([\\p{{L}}\\p{{N}}_]*)', 1), '')" for w in ("struct", "class", "enum"))


@query("str9_struct_name", f"WITH {_LINES}, x AS (SELECT doc_id, n, coalesce({_TYPES}) AS name FROM l) SELECT * FROM x WHERE name IS NOT NULL")
def str9(spark, sf):
    return lines(spark, sf).select("doc_id", "n", R.type_name(F.col("line")).alias("name")).where("name is not null")


@query("str12_type_reference", f"WITH {sql_code()}, d AS (SELECT doc_id, content, unnest({_any_sql(evidence.DEFINED)}) AS symbol FROM code) SELECT doc_id, symbol, " + " OR ".join(f"contains(lower(content), '{p}' || lower(symbol))" for p in (": ", "-> ", "<", "isinstance(_, ")) + " AS referred FROM d")
def str12(spark, sf):
    """Whether a source's own symbols stand as types in it."""
    d = sources(spark, sf).withColumn("symbol", F.explode(evidence.definitions("content")))
    return d.select("doc_id", "symbol", R.is_type_reference(F.col("content"), F.col("symbol")).alias("referred"))


@query("str16_trigram_hashes", """WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents)
SELECT doc_id, greatest(len(b) - 2, 0)::BIGINT AS n, coalesce(list_sum(list_transform(range(1, len(b) - 1), lambda i: xor(xor(b[i] * 1099511628211, b[i + 1] * 16777619), b[i + 2]))), 0)::BIGINT AS total FROM b""")
def str16(spark, sf):
    """How many trigrams of bytes a document has, and their sum modulo 2^64."""
    n = F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)) - 2, F.lit(0))
    return table(spark, sf, "documents").select("doc_id", n.cast("long").alias("n"), evidence.trigram_total("text").alias("total"))


_HEAD_SQL = "CASE lang " + " ".join(f"WHEN '{g}' THEN regexp_matches(x, {quoted('^(?:' + p.pattern + ')')})" for g, p in evidence.HEADS.items()) + " ELSE false END"
_OF_PATH = "CASE " + " ".join(f"WHEN ends_with(path, '{e}') THEN '{g}'" for e, g in ((".py", "python"), (".rs", "rust"), (".go", "go"), (".js", "javascript"), (".java", "java"))) + " END"


@query("str33_extract_skeleton", f"""WITH {sql_code()}, g AS (SELECT doc_id, content, {_OF_PATH} AS lang FROM code), l AS (SELECT doc_id, content, lang, list_filter(string_split(content, chr(10)), lambda x: {_HEAD_SQL}) AS heads FROM g WHERE lang IS NOT NULL),
s AS (SELECT doc_id, content, array_to_string(list_transform(heads, lambda x: CASE WHEN regexp_matches(rtrim(x), '[:{{]$') THEN rtrim(x) || ' ...' ELSE rtrim(x) END), chr(10)) AS s FROM l WHERE len(string_split(content, chr(10))) >= 5)
SELECT doc_id, md5(s) AS skeleton FROM s WHERE length(s) >= 10 AND length(s) <= 0.7 * length(content)""")
def str33(spark, sf):
    """The outline of each source in a language that has one."""
    g = R.first_of([(g, F.col("path").endswith(e)) for e, g in ((".py", "python"), (".rs", "rust"), (".go", "go"), (".js", "javascript"), (".java", "java"))], None)
    return sources(spark, sf).select("doc_id", F.md5(evidence.skeleton(F.col("content"), g)).alias("skeleton")).where("skeleton is not null")


@query("join24_scaffold", f"""WITH {sql_code()}, u AS (SELECT doc_id AS src, unnest(list_distinct(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]+'))) AS symbol FROM code), d AS (SELECT doc_id AS dst, unnest({_any_sql(evidence.DEFINED)}) AS symbol FROM code WHERE doc_id < 20)
SELECT symbol, count(*) AS edges FROM (SELECT DISTINCT src, dst, symbol FROM u JOIN d USING (symbol) WHERE src <> dst) GROUP BY symbol""")
def join24(spark, sf):
    """Which sources use what the selection (the first twenty, by the query) defines."""
    s = sources(spark, sf)
    uses = s.select(F.col("doc_id").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]+"), F.lit(0)))).alias("symbol"))
    defined = s.where("doc_id < 20").select(F.col("doc_id").alias("dst"), F.explode(evidence.definitions("content")).alias("symbol"))
    return knowledge.scaffold(uses, defined).groupBy("symbol").agg(F.count("*").alias("edges"))


@query("join27_reverse_index", f"WITH {sql_code()}, d AS (SELECT path, unnest({_any_sql(evidence.DEFINED)}) AS symbol FROM code) SELECT path, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS exports FROM d GROUP BY path")
def join27(spark, sf):
    d = sources(spark, sf).select("path", F.explode(evidence.definitions("content")).alias("symbol"))
    return d.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("exports"))


@query("api15_extract_entities", f"WITH {sql_code()}, d AS (SELECT unnest({_any_sql(evidence.DEFINED)}) AS symbol FROM code) SELECT symbol, count(*) AS n FROM d GROUP BY symbol")
def api15(spark, sf):
    return str6(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))


@query("api14_compile_beliefs", f"WITH {sql_code()}, d AS (SELECT path, unnest({_any_sql(evidence.DEFINED)}) AS symbol FROM code), i AS (SELECT path, unnest({_any_sql(evidence.IMPORTED)}) AS target FROM code), a AS (SELECT path, count(*) AS definitions FROM d GROUP BY path), b AS (SELECT path, count(DISTINCT target) AS imports FROM i GROUP BY path) SELECT path, coalesce(definitions, 0) AS definitions, coalesce(imports, 0) AS imports FROM a FULL JOIN b USING (path)")
def api14(spark, sf):
    """A note for each module: how much it defines, and how many others it needs."""
    s = sources(spark, sf)
    d = s.select("path", F.explode(evidence.definitions("content")).alias("symbol")).groupBy("path").agg(F.count("*").alias("definitions"))
    i = s.select("path", F.explode(evidence.imports("content")).alias("target")).groupBy("path").agg(F.countDistinct("target").alias("imports"))
    return d.join(i, "path", "full").select("path", F.coalesce("definitions", F.lit(0)).alias("definitions"), F.coalesce("imports", F.lit(0)).alias("imports"))


@query("join8_lsh_tables", "SELECT t::INT AS t, place::INT AS place FROM (VALUES " + ", ".join(f"({t}, {p})" for t, ps in enumerate(C.LSH_PLACES) for p in ps) + ") v(t, place)")
def join8(spark, sf):
    """The bits of each LSH table's key."""
    return spark.createDataFrame([(t, p) for t, places in enumerate(C.LSH_PLACES) for p in places], "t int, place int")


# ---- beliefs and notes: labelled documents ----

_BELIEFS = f"bl AS (SELECT doc_id, 'doc' || doc_id AS entity, CASE WHEN quality = 1 THEN 'verified' WHEN toxic = 1 THEN 'refuted' ELSE 'inferred' END AS status, round(least(1.0, length(text) / 4000.0), 6) AS confidence, {sql_pick(PATHS, 'doc_id')} AS path, text FROM documents JOIN labels USING (doc_id))"


def beliefs(spark, sf):
    """Labelled documents as beliefs: status by their labels, confidence by their length."""
    d = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id")
    status = F.when(F.col("quality") == 1, "verified").when(F.col("toxic") == 1, "refuted").otherwise("inferred")
    return d.select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("entity"), status.alias("status"), _r(F.least(F.lit(1.0), F.length("text") / 4000.0)).alias("confidence"), pick(PATHS, F.col("doc_id")).alias("path"), "text")


_NOTE = "'---' || chr(10) || 'entity: ' || entity || chr(10) || 'status: ' || status || chr(10) || 'confidence: ' || confidence || chr(10) || '---' || chr(10)"


@query("src25_write_beliefs", f"WITH {_BELIEFS} SELECT entity, status, md5(text) AS body FROM bl")
def src25(spark, sf):
    """Beliefs written as notes with a head, a note a record, and read back."""
    from ..sources import files
    from .outside import _folder

    b = beliefs(spark, sf)
    note = F.concat(F.lit("---\nentity: "), "entity", F.lit("\nstatus: "), "status", F.lit("\n---\n"), "text")
    notes = files.write_notes(b.select(note.alias("note")), f"{_folder(spark)}/notes")
    t = F.col("note")
    return notes.select(files.frontmatter(t, "entity").alias("entity"), files.frontmatter(t, "status").alias("status"), F.md5(F.regexp_extract(t, r"(?s)\A---\n.*?\n---\n(.*)\z", 1)).alias("body"))


@query("src26_list_beliefs", f"WITH {_BELIEFS} SELECT status, count(*) AS n, round(avg(confidence), 6) AS confidence FROM bl GROUP BY status")
def src26(spark, sf):
    return beliefs(spark, sf).groupBy("status").agg(F.count("*").alias("n"), _r(F.avg("confidence")).alias("confidence"))


_STEM = "lower(regexp_extract(path, '([^/.:]*)(?:\\.[^/]*)?$', 1))"


@query("src17_load_beliefs", f"WITH {_BELIEFS}, k AS (SELECT {_STEM} AS stem, max_by(entity, struct_pack(c := confidence, d := -doc_id)) AS entity FROM bl GROUP BY 1), f AS (SELECT doc_id, {_STEM} AS stem FROM (SELECT doc_id, {sql_pick(PATHS, 'doc_id')} AS path FROM documents)) SELECT doc_id, entity FROM f LEFT JOIN k USING (stem)")
def src17(spark, sf):
    """Fragments with the surest belief on the stem of their path."""
    stem = F.lower(F.regexp_extract("path", r"([^/.:]*)(?:\.[^/]*)?$", 1))
    best = beliefs(spark, sf).groupBy(stem.alias("stem")).agg(F.max_by("entity", F.struct("confidence", -F.col("doc_id"))).alias("entity"))
    f = table(spark, sf, "documents").select("doc_id", pick(PATHS, F.col("doc_id")).alias("path"))
    return knowledge.inject(f, best, stem).select("doc_id", "entity")


_ASKED = f"q AS (SELECT list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS qw FROM documents WHERE doc_id = 7)"


@query("join22_project_beliefs", f"""WITH {_BELIEFS}, {_ASKED}, m AS (SELECT max(doc_id) AS now FROM documents), w AS (SELECT entity, confidence, 1 - (now - doc_id) / (now + 1) AS recency, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM bl, m WHERE confidence >= 0.6 AND status NOT IN ('stale', 'retracted', 'refuted'))
SELECT entity, round(confidence * recency * len(list_intersect(w, qw)) / len(list_distinct(w || qw)), 6)::DOUBLE AS score FROM w, q WHERE len(list_intersect(w, qw)) > 0 ORDER BY score DESC, entity LIMIT 20""")
def join22(spark, sf):
    """The twenty beliefs for a question: sure and not refuted, by confidence, recency and Jaccard. The question is one row to all."""
    d = table(spark, sf, "documents")
    words = lambda c: F.array_distinct(X.words_of(F.col(c)))
    asked = d.where("doc_id = 7").select(words("text").alias("qw")).crossJoin(d.agg(F.max("doc_id").alias("now")))
    b = beliefs(spark, sf).where("confidence >= 0.6 and status not in ('stale', 'retracted', 'refuted')").withColumn("w", words("text")).crossJoin(F.broadcast(asked))
    score = F.col("confidence") * (1 - (F.col("now") - F.col("doc_id")) / (F.col("now") + 1)) * X.jaccard(F.col("w"), F.col("qw"))
    return b.where(F.size(F.array_intersect("w", "qw")) > 0).select("entity", _r(score).alias("score")).orderBy(F.desc("score"), "entity").limit(20)


@query("join28_recall_memory", f"WITH {_ASKED}, w AS (SELECT conv_id, turn, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')), qw)) AS shared FROM conversations, q) SELECT conv_id, turn, shared::INT AS shared FROM w WHERE shared > 0 ORDER BY shared DESC, conv_id, turn LIMIT 10")
def join28(spark, sf):
    """The ten turns of earlier conversations that share most words with a question."""
    q = table(spark, sf, "documents").where("doc_id = 7").select(F.array_distinct(X.words_of(F.col("text"))).alias("qw"))
    c = table(spark, sf, "conversations").crossJoin(F.broadcast(q)).select("conv_id", "turn", F.size(F.array_intersect(F.array_distinct(X.words_of(F.col("text"))), "qw")).alias("shared"))
    return c.where("shared > 0").orderBy(F.desc("shared"), "conv_id", "turn").limit(10)


@query("agg28_broken_links", f"WITH {_BELIEFS}, n AS (SELECT entity, '[[doc' || (doc_id + 3) || ']] [[' || status || '|x]] ' || text AS t FROM bl), l AS (SELECT entity, unnest(list_distinct(regexp_extract_all(t, '\\[\\[([^\\]|]+)', 1))) AS link FROM n) SELECT entity, link FROM l WHERE link NOT IN (SELECT entity FROM bl)")
def agg28(spark, sf):
    b = beliefs(spark, sf)
    notes = b.select("entity", F.concat(F.lit("[[doc"), F.col("doc_id") + 3, F.lit("]] [["), "status", F.lit("|x]] "), "text").alias("t"))
    return knowledge.broken_links(notes, "entity", "t", b.select(F.col("entity").alias("link")))


@query("agg30_blast_radius", f"WITH {_BELIEFS}, s(stem) AS (VALUES ('handler'), ('engine'), ('user'), ('doc1')), a AS (SELECT stem, entity FROM bl JOIN s ON contains(lower(path), stem) OR contains(lower(entity), stem) OR contains(lower(text), stem)) SELECT stem, count(DISTINCT entity) AS affected, CASE WHEN count(DISTINCT entity) <= 2 THEN 'low' WHEN count(DISTINCT entity) <= 5 THEN 'medium' ELSE 'high' END AS risk FROM a GROUP BY stem")
def agg30(spark, sf):
    """Beliefs that a changed file touches, by its stem in their source, entity or body; the changed stems are a few literals."""
    low = F.lower(F.concat_ws("\x00", "path", "entity", "text"))
    hits = beliefs(spark, sf).select("entity", F.explode(F.array_compact(F.array(*[F.when(low.contains(s), F.lit(s)) for s in ("handler", "engine", "user", "doc1")]))).alias("stem"))
    n = F.countDistinct("entity")
    return hits.groupBy("stem").agg(n.alias("affected"), F.when(n <= 2, "low").when(n <= 5, "medium").otherwise("high").alias("risk"))


@query("agg27_verification_pass", f"WITH {_BELIEFS}, m AS (SELECT max(doc_id) AS now FROM documents) SELECT count(*) AS beliefs, count(*) FILTER (now - doc_id > 500) AS stale, count(*) FILTER (status = 'refuted') AS refuted, round(avg(confidence), 6) AS confidence FROM bl, m")
def agg27(spark, sf):
    b = beliefs(spark, sf).crossJoin(F.broadcast(table(spark, sf, "documents").agg(F.max("doc_id").alias("now"))))
    return b.agg(F.count("*").alias("beliefs"), F.count_if(F.col("now") - F.col("doc_id") > 500).alias("stale"), F.count_if(F.col("status") == "refuted").alias("refuted"), _r(F.avg("confidence")).alias("confidence"))


@query("src34_export_training_data", f"WITH {_BELIEFS} SELECT entity, status, md5(text) AS digest FROM bl WHERE status = 'verified'")
def src34(spark, sf):
    """Verified beliefs written as JSON lines, and read back."""
    from ..sources import files
    from .outside import _folder

    rows = beliefs(spark, sf).where("status = 'verified'").select("entity", "status", "text")
    return files.round_trip_json(rows, f"{_folder(spark)}/training").select("entity", "status", F.md5("text").alias("digest"))


@query("src12_persist_index", f"WITH {FRAGMENTS} SELECT doc_id, tokens, round(score, 6)::DOUBLE AS score FROM sc")
def src12(spark, sf):
    """The scored fragments written as a snapshot, and loaded again."""
    from ..sources import files
    from .outside import _folder

    return files.load_snapshot(spark, files.save_snapshot(scored(spark, sf).select("doc_id", "tokens", _r("score").alias("score")), f"{_folder(spark)}/index"))


@query("src19_load_latest", "SELECT user_id, max(event_id) AS turn FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def src19(spark, sf):
    """Of two checkpoints (compressed JSON) the newest is read."""
    from ..sources import files
    from .outside import _folder

    e = table(spark, sf, "events")
    folder = f"{_folder(spark)}/checkpoints-{spark.sparkContext.startTime}-{id(e)}"
    for k, kinds in enumerate((["view"], ["view", "click"])):
        files.save_checkpoint(e.where(F.col("event_type").isin(*kinds)).groupBy("user_id").agg(F.max("event_id").alias("turn")), folder, k)
    return files.load_latest(spark, folder, "user_id long, turn long")


@query("src11_path_stubs", f"WITH d AS (SELECT {sql_pick(PATHS, 'doc_id')} AS path, n_chars FROM documents) SELECT path, count(*) AS stubs, greatest(1, sum(n_chars)::BIGINT // 4) AS tokens FROM d GROUP BY path")
def src11(spark, sf):
    """Fragments known by path and size alone: no text is read."""
    d = table(spark, sf, "documents").select(pick(PATHS, F.col("doc_id")).alias("path"), "n_chars")
    return d.groupBy("path").agg(F.count("*").alias("stubs"), F.greatest(F.lit(1), F.floor(F.sum("n_chars") / 4)).cast("long").alias("tokens"))


@query("src20_merge_peers", "WITH u AS (SELECT user_id, max(event_id) AS turn, count(*) AS n, peer FROM (SELECT user_id, event_id, (event_type <> 'view')::INT AS peer FROM events) GROUP BY user_id, peer) SELECT user_id, turn, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn DESC, n DESC, peer) AS r FROM u) WHERE r = 1")
def src20(spark, sf):
    """What two peers know of each fragment's use: the newer access, then the more frequent, then the own."""
    from ..sources import files

    e = table(spark, sf, "events")
    side = lambda c: e.where(c).groupBy("user_id").agg(F.max("event_id").alias("turn"), F.count("*").alias("n"))
    return files.merge_peers([side(F.col("event_type") == "view"), side(F.col("event_type") != "view")], "user_id", "turn", "n")


# ---- graphs and health ----


@query("ret24_node_count", f"WITH {_EDGES} SELECT count(*) AS nodes FROM (SELECT src FROM ed UNION SELECT dst FROM ed)")
def ret24(spark, sf):
    return _nodes(_edges(spark, sf)).agg(F.count("*").alias("nodes"))


@query("agg15_graph_stats", f"WITH {_EDGES}, o AS (SELECT src, count(*) AS n FROM ed GROUP BY src) SELECT count(*) AS sources, sum(n)::BIGINT AS edges, max(n) AS most, round(avg(n), 6) AS mean FROM o")
def agg15(spark, sf):
    o = _edges(spark, sf).groupBy("src").agg(F.count("*").alias("n"))
    return o.agg(F.count("*").alias("sources"), F.sum("n").alias("edges"), F.max("n").alias("most"), _r(F.avg("n")).alias("mean"))


@query("agg14_dedup_report", "WITH h AS (SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), ' ')) AS h, greatest(1, octet_length(encode(text)) // 4) AS t FROM documents), g AS (SELECT h, count(*) AS n, sum(t) AS t, min_by(t, doc_id) AS kept FROM h GROUP BY h) SELECT sum(n)::BIGINT AS fragments, count(*) AS kept, (sum(n) - count(*))::BIGINT AS removed, (sum(t) - sum(kept))::BIGINT AS saved FROM g")
def agg14(spark, sf):
    """How many fragments and tokens the removal of copies saves."""
    d = table(spark, sf, "documents").select("doc_id", dedup.content_hash(F.col("text")).alias("h"), X.token_count(F.col("text")).alias("t"))
    g = d.groupBy("h").agg(F.count("*").alias("n"), F.sum("t").alias("t"), F.min_by("t", "doc_id").alias("kept"))
    return g.agg(F.sum("n").alias("fragments"), F.count("*").alias("kept"), (F.sum("n") - F.count("*")).alias("removed"), (F.sum("t") - F.sum("kept")).alias("saved"))


@query("agg34_observe_archetype", "WITH v AS (SELECT label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, k, avg(x) AS m FROM v GROUP BY ALL) SELECT v.label, count(DISTINCT v.k)::INT AS dims, round(sum((x - m) * (x - m)) / (count(*) / count(DISTINCT v.k)), 5) AS variance FROM v JOIN c ON v.label = c.label AND v.k = c.k GROUP BY v.label")
def agg34(spark, sf):
    """What each archetype has seen: its mean as centroid, and the mean squared distance to it; by sums, in any order."""
    v = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.col("x").cast("double"))
    s = v.groupBy("label", "k").agg(F.count("*").alias("n"), F.var_pop("x").alias("v"))
    return s.groupBy("label").agg(F.count("*").cast("int").alias("dims"), F.round(F.sum("v"), 5).alias("variance"))


@query("agg36_scan_codebase", f"WITH {sql_code()}, s AS (SELECT regexp_extract(path, '\\.([a-zA-Z]+)$', 1) AS ext, content, path FROM code) SELECT ext, count(*) AS files, count(*) FILTER (contains(lower(path), 'test')) AS tests, sum(length(content) - length(replace(content, chr(10), '')) + 1)::BIGINT AS lines FROM s GROUP BY ext")
def agg36(spark, sf):
    s = sources(spark, sf)
    n = F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit(""))) + 1
    return s.groupBy(F.regexp_extract("path", r"\.([a-zA-Z]+)$", 1).alias("ext")).agg(F.count("*").alias("files"), F.count_if(F.lower("path").contains("test")).alias("tests"), F.sum(n.cast("long")).alias("lines"))


@query("agg35_fingerprint", f"WITH {sql_code()}, s AS (SELECT count(*) AS n, avg(length(content)) AS size, count(DISTINCT path) AS paths, avg(contains(lower(path), 'test')::INT) AS tests, avg(contains(content, 'class ')::INT) AS classes, avg(contains(content, 'import ')::INT) AS imports, avg(contains(content, 'async ')::INT) AS asyncs FROM code) SELECT round(least(1.0, ln(1 + n) / 10), 6) AS volume, round(least(1.0, size / 10000), 6) AS size, round(paths / n, 6) AS variety, round(tests, 6) AS tests, round(classes, 6) AS classes, round(imports, 6) AS imports, round(asyncs, 6) AS asyncs FROM s")
def agg35(spark, sf):
    """A codebase as a few numbers from 0 to 1, in one pass."""
    share = lambda c: F.avg(c.cast("int"))
    has = lambda w: share(F.col("content").contains(w))
    n = F.count("*").cast("double")
    return sources(spark, sf).agg(
        _r(F.least(F.lit(1.0), F.log1p(n) / 10)).alias("volume"), _r(F.least(F.lit(1.0), F.avg(F.length("content")) / 10000)).alias("size"), _r(F.countDistinct("path") / n).alias("variety"),
        _r(share(F.lower("path").contains("test"))).alias("tests"), _r(has("class ")).alias("classes"), _r(has("import ")).alias("imports"), _r(has("async ")).alias("asyncs"),
    )


@query("join26_consolidation", f"WITH {FRAGMENTS}, {SIMHASH}, mm AS (SELECT min(doc_id) AS id, simhash FROM f GROUP BY simhash), pr AS (SELECT a.id AS a, b.id AS b FROM mm a JOIN mm b ON a.simhash <> b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3), u AS (SELECT a AS id, b AS o FROM pr UNION SELECT id, id FROM mm) SELECT u.id AS doc_id, max_by(u.o, struct_pack(w := fr.feedback, t := -fr.tokens, d := -u.o)) AS winner FROM u JOIN fr ON fr.doc_id = u.o GROUP BY u.id")
def join26(spark, sf):
    """Near fragments and the one that stands for each: the best fed back, then the shortest."""
    pairs = dedup.close_pairs(dedup.simhash(table(spark, sf, "documents").select("doc_id", "text")), 3)
    prints = dedup.simhash(table(spark, sf, "documents").select("doc_id", "text")).groupBy("simhash").agg(F.min("doc_id").alias("doc_id"))
    nodes = features(spark, sf).join(prints.select("doc_id"), "doc_id").select("doc_id", "feedback", (-F.col("tokens")).alias("short"))
    return knowledge.consolidate(pairs, nodes, "doc_id", ["feedback", "short"])


# ---- budgets, caches, learning ----

_FIT = "mx AS (SELECT count(*) AS n, avg(l_quantity / 50) AS mx, avg(l_discount) AS my, covar_pop(l_quantity / 50, l_discount) AS xy, var_pop(l_quantity / 50) AS xx, var_pop(l_discount) AS yy FROM lineitem), md AS (SELECT n, xy / (xx + 1.0 / n) AS slope, my - xy / (xx + 1.0 / n) * mx AS intercept, sqrt(greatest(0, yy - 2 * xy / (xx + 1.0 / n) * xy + pow(xy / (xx + 1.0 / n), 2) * xx) / n) AS error FROM mx)"


def _model(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_quantity") / 50).alias("x"), F.col("l_discount").alias("y"))
    return knowledge.ridge(rows, "x", "y", 1.0)


@query("sel31_fit_budget", f"WITH {_FIT} SELECT round(intercept, 6) AS intercept, round(slope, 6) AS slope, n, round(error, 8) AS error FROM md")
def sel31(spark, sf):
    return _model(spark, sf).select(_r("intercept").alias("intercept"), _r("slope").alias("slope"), "n", F.round("error", 8).alias("error"))


@query("sel30_predict_budget", f"WITH {_FIT} SELECT p_partkey, round(CASE WHEN error > 0.1 THEN 0.2 ELSE greatest(0.05, least(0.95, intercept + slope * p_size / 50)) END, 6)::DOUBLE AS budget FROM part, md")
def sel30(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 50).alias("x"))
    return knowledge.predict_budget(_model(spark, sf), p, "x").select("p_partkey", _r("budget").alias("budget"))


@query("sel35_policy_gradient", f"WITH {FRAGMENTS}, mr AS (SELECT avg(feedback) AS m FROM sc) SELECT {', '.join(f'round(sum((feedback - m) * (1 - 1 / (1 + exp(-score))) * {c}), 5) AS {c}' for c in ('recency', 'frequency', 'semantic', 'entropy'))} FROM sc, mr")
def sel35(spark, sf):
    g = knowledge.policy_gradient(scored(spark, sf), ["recency", "frequency", "semantic", "entropy"], F.col("feedback"), 1 / (1 + F.exp(-F.col("score"))))
    return g.select(*[F.round(c, 5).alias(c) for c in ("recency", "frequency", "semantic", "entropy")])


@query("lrn15_contributions", f"WITH {FRAGMENTS} SELECT {', '.join(f'round(sum({w} * {c} * feedback) / sum(score), 6) AS {c}' for c, w in (('recency', 0.3), ('frequency', 0.25), ('semantic', 0.25), ('entropy', 0.2)))} FROM sc")
def lrn15(spark, sf):
    """The share of all scores that each feature gives."""
    s = scored(spark, sf)
    return s.agg(*[_r(F.sum(w * F.col(c) * F.col("feedback")) / F.sum("score")).alias(c) for c, w in (("recency", 0.3), ("frequency", 0.25), ("semantic", 0.25), ("entropy", 0.2))])


@query("lrn7_record_reward", f"WITH {FRAGMENTS}, r AS (SELECT user_id, avg(CASE WHEN event_type = 'error' THEN -value ELSE value END / 100) AS reward FROM events GROUP BY user_id) SELECT doc_id, round(greatest(0.1, least(2.0, feedback + 0.1 * coalesce(reward, 0))), 6)::DOUBLE AS feedback FROM fr LEFT JOIN r ON user_id = doc_id")
def lrn7(spark, sf):
    """Each fragment's feedback moved by its mean reward, errors counted against it."""
    v = F.col("value") / 100
    r = table(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.avg(F.when(F.col("event_type") == "error", -v).otherwise(v)).alias("reward"))
    f = features(spark, sf).join(r, "doc_id", "left")
    return f.select("doc_id", _r(F.greatest(F.lit(0.1), F.least(F.lit(2.0), F.col("feedback") + 0.1 * F.coalesce("reward", F.lit(0.0))))).alias("feedback"))


@query("lrn6_record_failure", "SELECT user_id, count(*) AS failures, round(pow(0.9, count(*)), 6) AS worth FROM events WHERE event_type = 'error' GROUP BY user_id")
def lrn6(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("failures"))
    return e.select("user_id", "failures", _r(F.pow(F.lit(0.9), F.col("failures"))).alias("worth"))


_CACHE = "en AS (SELECT user_id, event_type, ln(1 + count(*)) + avg(value) / 100 AS worth, 1.0 AS quality FROM events GROUP BY ALL)"


@query("lrn26_store", f"WITH {_CACHE} SELECT user_id, event_type, round(worth, 6) AS worth FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(worth, 9) DESC, user_id) AS r FROM en) WHERE r <= 20")
def lrn26(spark, sf):
    """What a cache with room for twenty entries of each type keeps."""
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(F.log1p(F.count("*").cast("double")) + F.avg("value") / 100, 9).alias("worth"))
    return knowledge.admitted(e, "event_type", "worth", "user_id", 20).select("user_id", "event_type", _r("worth").alias("worth"))


@query("lrn30_invalidate", "WITH c AS (SELECT l_suppkey AS k, l_linenumber AS depth FROM lineitem WHERE l_returnflag = 'R'), h AS (SELECT k, sum(1.0 / depth) AS w, count(*) AS n FROM c GROUP BY k) SELECT s_suppkey, round(CASE WHEN n IS NULL THEN 1.0 ELSE exp(-ln(2.0) * w / n) END * CASE WHEN coalesce(n, 0) > 3 THEN 0.5 ELSE 1.0 END, 6)::DOUBLE AS quality FROM supplier LEFT JOIN h ON k = s_suppkey")
def lrn30(spark, sf):
    """Entries lose quality by the changes under them, less the deeper these are."""
    entries = table(spark, sf, "supplier").select("s_suppkey", F.lit(1.0).alias("quality"))
    changes = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_linenumber").alias("depth"))
    return knowledge.invalidate(entries, "s_suppkey", changes, "depth").select("s_suppkey", _r("quality").alias("quality"))


@query("lrn42_outcome_bridge", "WITH o AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view'), h AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'purchase'), j AS (SELECT h.event_id, h.value, max(o.event_id) AS seen FROM h JOIN o ON o.user_id = h.user_id AND o.ts <= h.ts AND h.ts <= o.ts + INTERVAL 1 DAY GROUP BY ALL) SELECT h.event_id, seen, seen IS NULL AS missed FROM h LEFT JOIN j USING (event_id)")
def lrn42(spark, sf):
    """Outcomes with the last observation of the same client within a day before, else missed: an ordered window, no pairs."""
    e = table(spark, sf, "events").where("event_type in ('view', 'purchase')")
    w = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(W.unboundedPreceding, -1)
    view = F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))
    rows = e.withColumn("last", F.max(view).over(w)).where("event_type = 'purchase'")
    fresh = F.col("ts") <= F.col("last.ts") + F.expr("INTERVAL 1 DAY")
    seen = F.when(fresh, F.col("last.event_id"))
    return rows.select("event_id", seen.alias("seen"), seen.isNull().alias("missed"))


@query("lrn46_shadow_costs", "SELECT event_type, count(*) AS n, round(sum(value) / 1000, 6) AS paid, round(sum(CASE WHEN value < 20 THEN value * 0.1 ELSE value END) / 1000, 6) AS shadow FROM events GROUP BY event_type")
def lrn46(spark, sf):
    """What requests cost, and what they would with the short ones on a cheap model."""
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), _r(F.sum(v) / 1000).alias("paid"), _r(F.sum(F.when(v < 20, v * 0.1).otherwise(v)) / 1000).alias("shadow"))


# ---- verifiers ----

_FEATURES = (("entity_precision", -1.4), ("number_consistency", -3.2), ("idf_lex_overlap", -1.2), ("quote_support", -2.4), ("forward_entail", -1.8), ("reverse_entail", -2.6), ("negation_polarity", -3.0), ("adequacy", -0.8), ("qa_alignment", -2.8))
_GATES = ("entity_precision", "number_consistency", "negation_polarity", "qa_alignment")
_VALUES = {name: f"(((l_linenumber * {k + 3} + l_suppkey) % 11) / 5.0 - 1)" for k, (name, _) in enumerate(_FEATURES)}
_Z = "6.0 + " + " + ".join(f"CASE WHEN {_VALUES[n]} < 0 AND {str(n in _GATES).lower()} THEN 0 ELSE {w} * greatest({_VALUES[n]}, 0) END" for n, w in _FEATURES)
_OPEN = " * ".join(f"CASE WHEN {_VALUES[n]} < 0 THEN 1 - least(-{_VALUES[n]}, 1.0) ELSE 1 END" for n in _GATES)


@query("wit13_continuous_risk", f"SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, least(1.0, 1 - (1 - 1 / (1 + exp(-({_Z})))) * ({_OPEN}))), 6)::DOUBLE AS risk FROM lineitem")
def wit13(spark, sf):
    """The risk of nine features from -1 to 1: logistic, with gates for the negative ones."""
    value = lambda k: ((F.col("l_linenumber") * (k + 3) + F.col("l_suppkey")) % 11) / 5.0 - 1
    risk = knowledge.continuous_risk({n: (value(k), w) for k, (n, w) in enumerate(_FEATURES)}, _GATES)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", _r(risk).alias("risk"))


@query("flt23_should_suppress", "WITH l(label, risk) AS (VALUES ('grounded', 0.05), ('contradicted', 0.92), ('unsupported', 0.80), ('unknown', 0.55), ('unknown', 0.80)), p(profile) AS (VALUES ('code'), ('rag'), ('qa'), ('summary'), ('chat'), ('dialogue')) SELECT label, risk::DOUBLE AS risk, profile, CASE label WHEN 'contradicted' THEN true WHEN 'unsupported' THEN profile NOT IN ('chat', 'dialogue') WHEN 'unknown' THEN profile IN ('code', 'rag', 'qa', 'benchmark_qa') OR risk >= 0.75 ELSE false END AS suppressed FROM l, p")
def flt23(spark, sf):
    """The table of decisions, for every verdict and kind of answer."""
    l = spark.createDataFrame([("grounded", 0.05), ("contradicted", 0.92), ("unsupported", 0.80), ("unknown", 0.55), ("unknown", 0.80)], "label string, risk double")
    rows = l.withColumn("profile", F.explode(F.array(*[F.lit(p) for p in ("code", "rag", "qa", "summary", "chat", "dialogue")])))
    return rows.withColumn("suppressed", knowledge.suppressed(F.col("label"), F.col("profile"), F.col("risk")))


@query("wit37_exact_verifier", "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 0)::VARCHAR AS claimed, l_extendedprice AS expected FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, abs(claimed::DOUBLE - expected) <= 0.01 OR abs(claimed::DOUBLE - expected) <= 0.000001 * abs(expected) AS equal FROM x")
def wit37(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_extendedprice", 0).cast("string").alias("claimed"), F.col("l_extendedprice").cast("string").alias("expected"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", knowledge.exact_match(F.col("claimed"), F.col("expected")).alias("equal"))


@query("wit38_structural_verifier", "SELECT event_id, json_valid(props) AND json_exists(props, '$.k') AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS valid FROM events")
def wit38(spark, sf):
    """Whether a payload is JSON with a whole number as k."""
    ok = F.coalesce(F.get_json_object("props", "$.k").rlike(r"^-?[0-9]+$"), F.lit(False))
    return table(spark, sf, "events").select("event_id", ok.alias("valid"))


@query("wit36_citation_verifier", "WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), c AS (SELECT conv_id, turn, before, unnest(string_split(text, '. ')) AS quote FROM p WHERE before IS NOT NULL) SELECT conv_id, turn, count(*) AS quotes, count(*) FILTER (contains(lower(before), lower(trim(quote)))) AS found FROM c WHERE length(trim(quote)) >= 10 GROUP BY ALL")
def wit36(spark, sf):
    """How many of a turn's sentences the turn before has word for word."""
    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    q = c.select("conv_id", "turn", "before", F.explode(F.split("text", r"\. ", -1)).alias("quote")).withColumn("quote", F.trim("quote")).where(F.length("quote") >= 10)
    return q.groupBy("conv_id", "turn").agg(F.count("*").alias("quotes"), F.count_if(F.lower("before").contains(F.lower("quote"))).alias("found"))


@query("wit8_quote_support", r"WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), n AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_%''.-]+', ' ', 'g')) AS q, trim(regexp_replace(lower(before), '[^\p{L}\p{N}_%''.-]+', ' ', 'g')) AS c FROM p WHERE before IS NOT NULL) SELECT conv_id, turn, (CASE WHEN q = '' OR NOT contains(c, q) THEN 0.0 WHEN octet_length(encode(q)) > 80 THEN 0.95 ELSE 0.82 END)::DOUBLE AS support FROM n")
def wit8(spark, sf):
    """Whether the turn before has the whole of a turn, both in plain form."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_%'.-]+", " "))
    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return c.select("conv_id", "turn", evidence.quote_support(plain("text"), plain("before")).alias("support"))


@query("wit39_exit_code_verifier", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END AS verdict FROM events")
def wit39(spark, sf):
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", "fail").otherwise("pass").alias("verdict"))


@query("wit26_train_char_ngrams", "WITH g AS (SELECT unnest(list_transform(range(1, length(lower(n_name)) - 1), lambda i: substr(lower(n_name), i, 3))) AS g FROM nation) SELECT g, count(*) AS n FROM g GROUP BY g")
def wit26(spark, sf):
    return evidence.char_ngrams(table(spark, sf, "nation").select(F.lower("n_name").alias("t")), "t", 3)


# ---- recipes, agents, federation ----

_RECIPES = (("fix-bug", "(?i)bug|crash", 0.9, 0.1), ("tests", "(?i)tests?", 0.7, 0.2), ("broken", "(?i)refactor", 0.99, 0.8), ("docs", "(?i)docs|explain", 0.5, 0.0), ("any", ".", 0.1, 0.0))


@query("api13_fast_path", "WITH r(recipe, pattern, fitness, missing) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {d})" for a, b, c, d in _RECIPES) + "), m AS (SELECT conv_id, turn, max_by(recipe, struct_pack(f := fitness, r := recipe)) AS recipe FROM conversations JOIN r ON missing <= 0.5 AND regexp_matches(text, pattern) WHERE role = 'user' GROUP BY ALL) SELECT * FROM m")
def api13(spark, sf):
    recipes = spark.createDataFrame(list(_RECIPES), "recipe string, pattern string, fitness double, missing double")
    return knowledge.best_recipe(table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text"), "text", recipes).select("conv_id", "turn", "recipe")


@query("api22_level_of_detail", "WITH l AS (SELECT user_id, count(*) / max(count(*)) OVER () AS load FROM events GROUP BY user_id) SELECT user_id, round(load, 6) AS load, CASE WHEN load >= 0.9 THEN 'minimal' WHEN load >= 0.7 THEN 'reduced' WHEN load >= 0.4 THEN 'standard' ELSE 'full' END AS detail FROM l")
def api22(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    l = n.crossJoin(F.broadcast(n.agg(F.max("n").alias("most")))).withColumn("load", F.col("n") / F.col("most"))
    return l.select("user_id", _r("load").alias("load"), knowledge.level_of_detail(F.col("load")).alias("detail"))


@query("api23_budget_tree", "WITH RECURSIVE t AS (SELECT 'r' || r_regionkey AS id, NULL AS up, 0.2::DOUBLE AS share FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.1 FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 0.05 FROM supplier), b AS (SELECT id, 0 AS level, 100000 * share AS budget FROM t WHERE up IS NULL UNION ALL SELECT t.id, level + 1, budget * share FROM b JOIN t ON t.up = b.id) SELECT id, level, round(budget, 6)::DOUBLE AS budget FROM b")
def api23(spark, sf):
    """What agents of three levels get of a budget."""
    row = lambda df, a, b, up, k, s: df.select(F.concat(F.lit(a), F.col(b)).alias("id"), (F.concat(F.lit(up), F.col(k)) if up else F.lit(None).cast("string")).alias("up"), F.lit(s).alias("share"))
    t = row(table(spark, sf, "region"), "r", "r_regionkey", None, None, 0.2).unionByName(row(table(spark, sf, "nation"), "n", "n_nationkey", "r", "n_regionkey", 0.1))
    t = t.unionByName(row(table(spark, sf, "supplier"), "s", "s_suppkey", "n", "s_nationkey", 0.05))
    return knowledge.spend(t, "id", "up", "share", 100000.0, 2).select("id", "level", _r("budget").alias("budget"))


@query("api21_merge_global", "WITH r AS (SELECT event_type, user_id, avg(value) AS x FROM events GROUP BY ALL), k AS (SELECT event_type, x, row_number() OVER (PARTITION BY event_type ORDER BY x) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM r) SELECT event_type, round(0.7 * 50 + 0.3 * avg(x), 6) AS weight FROM k WHERE n < 3 OR (i > greatest(1, n // 10) AND i <= n - greatest(1, n // 10)) GROUP BY event_type")
def api21(spark, sf):
    """Own weights (50) moved three tenths of the way to the trimmed mean of what all contributed."""
    from ..operators.health import trimmed_mean

    r = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("x"))
    return trimmed_mean(r, "event_type", "x").select("event_type", _r(0.7 * 50 + 0.3 * F.col("mean")).alias("weight"))


@query("set3_jaccard", "WITH c AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9_]+')))) AS w FROM conversations GROUP BY conv_id) SELECT a.conv_id, round(CASE WHEN len(list_distinct(a.w || b.w)) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) END, 6)::DOUBLE AS jaccard FROM c a JOIN c b ON b.conv_id = a.conv_id + 1")
def set3(spark, sf):
    """Each conversation's words against those of the next."""
    words = F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(words.alias("w"))
    n = c.select((F.col("conv_id") - 1).alias("conv_id"), F.col("w").alias("v"))
    union = F.size(F.array_union("w", "v"))
    return c.join(n, "conv_id").select("conv_id", _r(F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect("w", "v")) / union)).alias("jaccard"))
