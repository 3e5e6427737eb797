"""Queries of the search, vector and speaker operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.operators import density, search, speakers, vectors
from tessera.operators.chunks import chunk_documents
from tessera.plans import base
from tessera.plans.base import EPOCH, with_tables
from tessera.runtime import new_folder, pin, table

QUERIES, ORACLES = {}, {}

# English stop words, as the machine-learning library ships them.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very s t can will just don should now""".split()


def query(name, sql=None, *names):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(*names, body=sql) if names else sql
        return fn

    return add


def _docs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("document").alias("kind"), "text")
    return docs.unionByName(table(spark, d, "pages").select((F.col("page_id") + 1_000_000_000).alias("doc_id"), F.lit("webpage").alias("kind"), F.col("html").alias("text")))


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: Namespaces of documents and queries, where a query is about them.
DOC_SCOPE, QUERY_SCOPE = "doc_id % 3", "query_id % 3"
_TOK = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"
_DOCS = "docs AS (SELECT doc_id, 'document' AS kind, text FROM documents UNION ALL SELECT page_id + 1000000000, 'webpage', html FROM pages)"


def _index_sql(doc_scope="''", query_scope="''"):
    """DuckDB: tokens, postings, statistics, items of the queries and their hits."""
    return f"""WITH {_DOCS}, scoped AS (SELECT *, {doc_scope} AS ns FROM docs), tok AS (SELECT ns, doc_id, kind, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT ns, doc_id, kind, {_TOK} AS ts FROM scoped)),
stats AS (SELECT ns, doc_id, kind, coalesce(len({_TOK}), 0)::BIGINT AS len FROM scoped), post AS (SELECT ns, term, doc_id, kind, count(*) AS tf FROM tok GROUP BY ALL),
qt AS (SELECT query_id, {query_scope} AS ns, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: array_to_string({_TOK.replace("text", "w")}, ' ')), lambda x: x <> ''))) AS item FROM (SELECT item_id AS query_id, text FROM benchmark))""".replace("\\\\", "\\")


_INDEX = _index_sql()
_SCORE = """, ph AS (SELECT ns, item, len(ts) AS need, unnest(ts) AS term, generate_subscripts(ts, 1) AS no FROM (SELECT DISTINCT ns, item, string_split(item, ' ') AS ts FROM {qt} WHERE contains(item, ' '))),
found AS (SELECT ns, term AS item, doc_id, kind, tf FROM post WHERE (ns, term) IN (SELECT (ns, item) FROM {qt}) UNION ALL
  SELECT ns, item, doc_id, kind, count(*) AS tf FROM (SELECT ns, item, doc_id, kind, pos - no AS s FROM tok JOIN ph USING (ns, term) GROUP BY ns, item, doc_id, kind, s, need HAVING count(*) = need) GROUP BY ALL),
n AS (SELECT ns, count(*) AS n, avg(len) AS a FROM stats GROUP BY ns), df AS (SELECT ns, item, count(*) AS df FROM found GROUP BY ALL),
sc AS (SELECT query_id, doc_id, kind, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / a)))::DOUBLE AS bm25, count(*) AS matched
  FROM {qt} JOIN found USING (ns, item) JOIN df USING (ns, item) JOIN stats USING (ns, doc_id, kind) JOIN n USING (ns) GROUP BY ALL)"""
_TOP = """SELECT query_id, rank::INTEGER AS rank, doc_id, kind, round(bm25, 6) AS bm25, round(bm25 / (1 + bm25), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id, kind) AS rank FROM {0}) WHERE rank <= 10"""


def _index(spark, d, docs=None):
    docs = _docs(spark, d) if docs is None else docs
    return search.build_index(docs)


@query("x1_searchable_text", "SELECT id, kind, CASE WHEN kind = 'webpage' AND key % 3 = 0 THEN 'body ' || text ELSE coalesce(text, '') END AS text FROM artifacts", "artifacts")
def _(spark, d):
    a = base.artifacts(spark, d).select("id", "kind", "text", "key")
    odd = F.col("kind") == "transcript"
    md = (F.col("kind") == "webpage") & (F.col("key") % 3 == 0)
    a = a.select("id", "kind", md.alias("md"), F.when(~odd | (F.col("key") % 2 == 0), F.col("text")).alias("text"), F.concat(F.lit("body "), "text").alias("body"), F.array("text").alias("segments"), F.array("text").alias("chunks"))
    out = search.searchable_text(a.withColumn("kind", F.when(F.col("md"), "markdown").otherwise(F.col("kind"))))
    return out.withColumn("kind", F.when(F.col("kind") == "markdown", "webpage").otherwise(F.col("kind")))


@query("x2_tokenize", f"SELECT doc_id, len({_TOK})::INTEGER AS n, md5(array_to_string({_TOK}, ' ')) AS terms FROM documents")
def _(spark, d):
    t = tokenize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("terms"))


@query("x3_postings", _INDEX + " SELECT term, doc_id, kind, count(*) AS tf, array_to_string(list(pos ORDER BY pos), ',') AS positions, len FROM tok JOIN stats USING (ns, doc_id, kind) GROUP BY term, doc_id, kind, len")
def _(spark, d):
    return _index(spark, d)[0].select("term", "doc_id", "kind", "tf", F.array_join("positions", ",").alias("positions"), "len")


@query("x3_doc_stats", _INDEX + " SELECT doc_id, kind, len FROM stats")
def _(spark, d):
    return _index(spark, d)[1].select("doc_id", "kind", "len")


@query("x4_bm25_topk", _INDEX + _SCORE.format(qt="qt") + _TOP.format("sc"))
def x4_bm25(spark, d):
    return search.bm25_topk(_asked(spark, d), *_index(spark, d))


@query("x4n_namespaces", _index_sql(DOC_SCOPE, QUERY_SCOPE) + _SCORE.format(qt="qt") + _TOP.format("sc"))
def _(spark, d):
    docs = _docs(spark, d).withColumn("namespace", F.expr(DOC_SCOPE))
    return search.bm25_topk(_asked(spark, d).withColumn("namespace", F.expr(QUERY_SCOPE)), *_index(spark, d, docs))


@query("x4w_written_index", _INDEX + _SCORE.format(qt="qt") + _TOP.format("sc"))
def _(spark, d):
    path = new_folder(spark, "index")
    search.write_index(_docs(spark, d), path)
    return search.bm25_topk(_asked(spark, d), *search.read_index(spark, path))


@query("x7_kind_filter", _INDEX + _SCORE.format(qt="qt") + _TOP.format("(SELECT * FROM sc WHERE kind = 'webpage')"))
def _(spark, d):
    return search.bm25_topk(_asked(spark, d), *_index(spark, d), kinds=["webpage"])


@query("x4p_phrase_matches", f"""WITH {_DOCS}, tok AS (SELECT doc_id, kind, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM (SELECT doc_id, kind, {_TOK} AS ts FROM docs)),
ph AS (SELECT item_id AS query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS no, len(ts) AS need FROM (SELECT item_id, {_TOK} AS ts FROM benchmark))
SELECT query_id, doc_id, kind, count(*) AS n FROM (SELECT query_id, doc_id, kind, pos - no AS s FROM tok JOIN ph USING (term) GROUP BY query_id, doc_id, kind, s, need HAVING count(*) = need) GROUP BY ALL""")
def _(spark, d):
    return search.phrase_matches(_asked(spark, d), _index(spark, d)[0])


@query("x5_match_all_terms", _INDEX + f", q2 AS (SELECT * FROM qt WHERE item NOT IN {tuple(STOP_WORDS)})" + _SCORE.format(qt="q2") + ", need AS (SELECT query_id, count(*) AS need FROM q2 GROUP BY 1), al AS (SELECT sc.* FROM sc JOIN need USING (query_id) WHERE matched = need) " + _TOP.format("al"))
def _(spark, d):
    return search.match_all_terms(_asked(spark, d), *_index(spark, d), stop_words=STOP_WORDS)


@query("x5b_snippets", _INDEX + _SCORE.format(qt="qt") + f""", top AS ({_TOP.format("sc")}), w AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS ts FROM benchmark)
SELECT query_id, rank, doc_id, trim(substr(text, greatest(coalesce(list_filter(list_transform(ts, lambda t: instr(lower(text), t)), lambda p: p > 0)[1], 1) - 40, 1), 160), ' ' || chr(10)) AS snippet
FROM top JOIN docs USING (doc_id, kind) JOIN w USING (query_id)""")
def _(spark, d):
    top = search.bm25_topk(_asked(spark, d), *_index(spark, d))
    return search.with_snippets(top, _docs(spark, d), _asked(spark, d)).select("query_id", "rank", "doc_id", "snippet")


_LISTS = """, a AS (SELECT query_id, rank, doc_id AS id FROM ({top})), b AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, doc_id, kind) AS rank, doc_id AS id FROM sc), r AS (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 AS l FROM b WHERE rank <= 30),
f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((l, rank)) AS seen, count(DISTINCT l) AS in_lists, concat_ws(',', coalesce((max(rank) FILTER (l = 0))::VARCHAR, '-'), coalesce((max(rank) FILTER (l = 1))::VARCHAR, '-')) AS ranks FROM r GROUP BY ALL)
SELECT query_id, rank::INTEGER AS rank, id, round(score, 6) AS score, 's' || CASE WHEN seen[1] = 0 THEN 0 ELSE 1 END AS snippet, in_lists::INTEGER AS in_lists, ranks FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen, id) AS rank FROM f) WHERE rank <= 10"""


@query("x6_rrf_fuse", _INDEX + _SCORE.format(qt="qt") + _LISTS.format(top=_TOP.format("sc").replace("rank <= 10", "rank <= 30")))
def _(spark, d):
    scored = pin(search.score(_asked(spark, d), *_index(spark, d), best=30, by=("bm25", "matched")), "scored")
    a = search.ranked(scored, 30).select("query_id", F.col("doc_id").alias("id"), "rank", F.lit("s0").alias("snippet"))
    order = Window.partitionBy("query_id").orderBy(F.desc("matched"), "doc_id", "kind")
    b = scored.withColumn("rank", F.row_number().over(order)).filter("rank <= 30").select("query_id", F.col("doc_id").alias("id"), "rank", F.lit("s1").alias("snippet"))
    return search.rrf_fuse([a, b]).withColumn("ranks", F.array_join(F.col("ranks").cast("array<string>"), ",", "-"))


# --- vectors


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


def _questions(spark, d):
    return _vectors(spark, d).filter("vec_id % 20 = 0")


_D = "embedding::DOUBLE[]"


@query("v1_embed_text")
def _(spark, d):
    v = vectors.embed_text(chunk_documents(table(spark, d, "documents")), ["doc_id", "chunk_index"], "text")
    return v.select("doc_id", "chunk_index", F.size("vector").alias("dims"), F.round(vectors.norm(F.col("vector")), 6).alias("length"))


@query("v2_l2_normalize", f"SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) + 0.0::DOUBLE) AS unit FROM (SELECT vec_id, list_transform({_D}, lambda x: x * (vec_id + 1)) AS v FROM embeddings)")
def _(spark, d):
    v = F.transform("vector", lambda x: x.cast("double") * (F.col("vec_id") + 1))
    unit = _vectors(spark, d).select("vec_id", v.alias("v")).select("vec_id", vectors.l2_normalize(F.col("v")).alias("u"))
    return unit.select("vec_id", F.transform("u", lambda x: F.round(x, 6) + F.lit(0.0)).alias("unit"))


@query("v3_cosine", f"SELECT a.vec_id, round(CASE WHEN a.vec_id % 10 = 0 THEN 0 ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END::DOUBLE, 6) + 0.0::DOUBLE AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2")
def _(spark, d):
    a = _vectors(spark, d)
    b = a.select(F.col("vec_id").alias("other"), F.col("vector").alias("w"))
    j = a.join(b, F.floor(F.col("vec_id") / 2) == F.col("other"))
    w = F.when(F.col("vec_id") % 10 == 0, F.slice("w", 1, 3)).otherwise(F.col("w"))
    return j.select("vec_id", (F.round(vectors.cosine(F.col("vector"), w), 6) + F.lit(0.0)).alias("score"))


#: What a vector stands for: every fifth has no source.
SOURCE_ID, SOURCE_KIND, VECTOR_SCOPE = "CASE WHEN vec_id % 5 <> 0 THEN concat('s', vec_id % 300) END", "CASE WHEN vec_id % 5 <> 0 THEN CASE WHEN vec_id % 2 = 0 THEN 'document' ELSE 'webpage' END END", "concat('n', vec_id % 4)"
_TOPK = """SELECT query_id, rank::INTEGER AS rank, vec_id, coalesce({id}, vec_id::VARCHAR) AS id, coalesce({kind}, 'embedding') AS kind, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q JOIN (SELECT *, {kind} AS source_kind FROM embeddings) v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0 {more})) WHERE rank <= 10"""


def _sourced(spark, d):
    return _vectors(spark, d).withColumns({"source_id": F.expr(SOURCE_ID), "source_kind": F.expr(SOURCE_KIND)})


@query("v4_semantic_topk", _TOPK.format(id=SOURCE_ID, kind=SOURCE_KIND, more=""))
def _(spark, d):
    return vectors.semantic_topk(_questions(spark, d), _sourced(spark, d))


@query("v4k_kind_and_namespace", _TOPK.format(id=SOURCE_ID, kind=SOURCE_KIND, more="AND v.source_kind IN ('document', 'webpage') AND q.vec_id % 4 = v.vec_id % 4"))
def _(spark, d):
    scope = F.expr(VECTOR_SCOPE)
    return vectors.semantic_topk(_questions(spark, d).withColumn("namespace", scope), _sourced(spark, d).withColumn("namespace", scope), kinds=["document", "webpage"])


@query("v5_ann_topk")
def _(spark, d):
    return vectors.ann_topk(_questions(spark, d), _vectors(spark, d))


def _labels(spark, d):
    """The least vector of each label stands for it."""
    v = _vectors(spark, d)
    return v.groupBy("label").agg(F.min_by("vector", "vec_id").alias("vector"))


_ZERO = "c AS (SELECT e.vec_id, l.label, 100 * list_cosine_similarity(e.embedding::DOUBLE[], l.v) AS c FROM embeddings e, (SELECT label, min_by(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label) l), s AS (SELECT vec_id, label, round(exp(c - m) / sum(exp(c - m)) OVER (PARTITION BY vec_id), 6) AS score FROM (SELECT *, max(c) OVER (PARTITION BY vec_id) AS m FROM c))"


@query("v6_zero_shot_scores", f"WITH {_ZERO} SELECT * FROM s")
def _(spark, d):
    return vectors.zero_shot_scores(_vectors(spark, d), _labels(spark, d))


@query("v6_zero_shot_best", f"WITH {_ZERO} SELECT vec_id, arg_max(label, (score, -label)) AS label FROM s GROUP BY vec_id")
def _(spark, d):
    return vectors.zero_shot_best(vectors.zero_shot_scores(_vectors(spark, d), _labels(spark, d)))


# Sources are drawn from all documents and a tenth more, which are not there.
_SOURCE = "sha256('document|' || (vec_id * 7 % ((SELECT count(*) FROM documents) * 11 // 10)))"


@query("v7_vector_sync", f"SELECT vec_id, e.source_id, coalesce(a.kind, 'embedding') AS kind FROM (SELECT vec_id, {_SOURCE} AS source_id FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 7 <> 0) e LEFT JOIN artifacts a ON a.id = e.source_id", "artifacts")
def _(spark, d):
    v = _vectors(spark, d)
    n = base.document_count(spark, d)
    vs = v.select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.slice("vector", 1, 5)).otherwise(F.col("vector")).alias("vector"), F.array(base.artifact_id("document", F.col("vec_id") * 7 % (n * 11 // 10))).alias("derived_from"))
    return vectors.vector_sync(vs, base.artifacts(spark, d), v.filter("vec_id % 3 = 0"), 64)


# --- speakers


@query("d1_intro_text", """SELECT recording_id, speaker_id, string_agg(text, ' ' ORDER BY start, seq) AS text FROM (SELECT *, first_value(start) OVER w + 30 AS cutoff, max("end") OVER (PARTITION BY recording_id, speaker_id ORDER BY start, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far
FROM segments WHERE speaker_id NOT IN ('', 'UNKNOWN') WINDOW w AS (PARTITION BY recording_id, speaker_id ORDER BY start, seq)) WHERE so_far IS NULL OR so_far < cutoff GROUP BY ALL""", "segments")
def _(spark, d):
    return speakers.intro_text(base.segments(spark, d))


def _candidates(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("alias"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("canonical"))
    return speakers.fuzzy_candidates(speakers.intro_text(base.segments(spark, d)), names)


@query("d2_fuzzy_candidates")
def _(spark, d):
    return _candidates(spark, d)


def _given_scores(spark, d):
    """Scores of names made of the conversations: three candidates a speaker."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("recording_id"), F.col("role").alias("speaker_id"), "turn", F.length("text").alias("n"))
    return c.select("recording_id", "speaker_id", F.col("turn").cast("int").alias("place"), F.concat(F.lit("A"), "turn").alias("alias"), F.concat(F.lit("N"), (F.col("n") % 4).cast("string")).alias("canonical"), (60 + F.col("n") % 41).cast("double").alias("score"))


@query("d3_resolve_names", """, g AS (SELECT conv_id AS recording_id, role AS speaker_id, turn AS place, 'N' || (length(text) % 4) AS canonical, (60 + length(text) % 41)::DOUBLE AS score FROM conversations),
b AS (SELECT recording_id, speaker_id, arg_max(canonical, (score, -place)) AS best, arg_max(place, (score, -place)) AS pl, max(score) AS top FROM g GROUP BY ALL), r AS (SELECT recording_id, speaker_id, best, pl, top, max(score) FILTER (canonical <> best) AS runner_up FROM g JOIN b USING (recording_id, speaker_id) GROUP BY ALL)
SELECT recording_id, speaker_id, CASE WHEN top / 100 >= 0.7 AND (runner_up IS NULL OR top - runner_up >= 5) THEN best END AS name, top AS score, runner_up, 'A' || pl AS matched FROM r""", "segments")
def _(spark, d):
    return speakers.resolve_names(_given_scores(spark, d))


_NAMED = ORACLES["d3_resolve_names"].replace("SELECT recording_id, speaker_id, CASE WHEN top", ", nm AS (SELECT recording_id, speaker_id, CASE WHEN top") + ")"
_META = """SELECT s.recording_id, s.seq, s.speaker_id, nm.name AS speaker_name, CASE WHEN nm.name IS NULL AND nm.score IS NOT NULL THEN 0 ELSE nm.score END::DOUBLE AS match_score, CASE WHEN nm.name IS NOT NULL THEN matched END AS matched_candidate,
CASE WHEN nm.score IS NULL THEN NULL WHEN nm.name IS NULL THEN 0 ELSE coalesce(runner_up, 0) END::DOUBLE AS runner_up_score, n_name AS nation FROM segments s LEFT JOIN nm USING (recording_id, speaker_id) LEFT JOIN nation ON 'N' || n_nationkey = nm.name"""


@query("d4_attach_names", f"{_NAMED} {_META}")
def _(spark, d):
    people = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("canonical"), F.create_map(F.lit("nation"), "n_name").alias("extra"))
    out = speakers.attach_names(base.segments(spark, d), speakers.resolve_names(_given_scores(spark, d)), people)
    return out.select("recording_id", "seq", "speaker_id", "speaker_name", "match_score", "matched_candidate", "runner_up_score", F.col("speaker_extra")["nation"].alias("nation"))


def _turn_vectors(spark, d):
    v = _vectors(spark, d).withColumn("vec_id", F.col("vec_id"))
    start = F.col("vec_id") % 7 * 3.0
    t = F.struct(F.concat(F.lit("S"), F.col("label").cast("string")).alias("speaker_id"), start.alias("start"), (start + F.col("vec_id") % 5 * 0.4).alias("end"), F.when(F.col("vec_id") % 13 == 0, F.array().cast("array<float>")).otherwise(F.col("vector")).alias("vector"))
    return v.groupBy(F.floor(F.col("vec_id") / 7).alias("embedding_id")).agg(F.array_sort(F.collect_list(t)).alias("turns"))


@query("d5_gather_turn_vectors", "SELECT vec_id // 7 AS embedding_id, 'S' || label AS speaker_id, round(vec_id % 7 * 3.0, 6)::DOUBLE AS start, round(vec_id % 7 * 3.0 + vec_id % 5 * 0.4::DOUBLE, 6)::DOUBLE AS \"end\", 64 AS dims FROM embeddings WHERE vec_id % 5 * 0.4 >= 0.5 AND vec_id % 13 <> 0")
def _(spark, d):
    g = speakers.gather_turn_vectors(_turn_vectors(spark, d))
    return g.select("embedding_id", "speaker_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.size("vector").alias("dims"))


@query("d6_density_cluster")
def _(spark, d):
    return density.density_cluster(_vectors(spark, d), min_samples=3, min_cluster_size=5)


_CENTER = """p AS (SELECT vec_id, label, vec_id % 3 AS ns, generate_subscripts(e, 1) AS i, unnest(e) / sqrt(list_sum(list_transform(e, lambda y: y * y))) AS x FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)),
m AS (SELECT {key}, i, avg(x) AS x FROM p {where} GROUP BY ALL), c AS (SELECT {key}, list(x ORDER BY i) AS v FROM m GROUP BY ALL), u AS (SELECT {key}, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM c)"""


@query("d7_centroids", f"WITH {_CENTER.format(key='label', where='WHERE label <> -1')}, k AS (SELECT label, array_to_string(list_sort(list(vec_id)), ',') AS member_ids, count(*) AS member_count FROM embeddings GROUP BY label) SELECT label, list_transform(v, lambda x: round(x, 5) + 0.0::DOUBLE) AS centroid, member_ids, member_count FROM u JOIN k USING (label)")
def _(spark, d):
    c = speakers.centroids(_vectors(spark, d))
    return c.select("label", F.transform("centroid", lambda x: F.round(x, 5) + F.lit(0.0)).alias("centroid"), F.array_join("member_ids", ",").alias("member_ids"), "member_count")


def _profiles(spark, d):
    """Saved profiles: centroids of the vectors of each label and namespace whose id is even."""
    v = _vectors(spark, d).filter("vec_id % 2 = 0").withColumn("label", F.concat((F.col("vec_id") % 3).cast("string"), F.lit("|"), F.col("label").cast("string")))
    part = F.split("label", r"\|")
    c = speakers.centroids(v)
    return c.select(F.concat(F.lit("n"), part[0]).alias("namespace"), F.concat(F.lit("P"), part[1]).alias("speaker_id"), part[1].cast("int").alias("label"), "centroid", "member_count", F.lit(EPOCH).alias("created"), F.lit(EPOCH).alias("updated"))


def _new(spark, d):
    """New centroids, of the odd ids; labels from 5 on have no saved profile in namespace n0."""
    v = _vectors(spark, d).filter("vec_id % 2 = 1").withColumn("label", F.concat((F.col("vec_id") % 3).cast("string"), F.lit("|"), F.col("label").cast("string")))
    part = F.split("label", r"\|")
    return speakers.centroids(v).select(F.concat(F.lit("n"), part[0]).alias("namespace"), part[1].cast("int").alias("label"), "centroid", "member_count")


@query("d8_reconcile")
def _(spark, d):
    return speakers.reconcile(_new(spark, d), _profiles(spark, d).filter("not (namespace = 'n0' and label >= 5)"))


@query("d8_first_round", f"""WITH a AS (SELECT 'n' || ns AS namespace, label, v FROM (WITH {_CENTER.format(key='ns, label', where='WHERE vec_id % 2 = 1')} SELECT * FROM u)), b AS (SELECT 'n' || ns AS namespace, 'P' || label AS speaker_id, v AS w FROM (WITH {_CENTER.format(key='ns, label', where='WHERE vec_id % 2 = 0')} SELECT * FROM u)),
s AS (SELECT namespace, label, speaker_id, list_cosine_similarity(v, w) AS score FROM a JOIN b USING (namespace))
SELECT namespace, label, round(max(score), 6) AS best_score FROM s GROUP BY ALL""")
def _(spark, d):
    return speakers.reconcile(_new(spark, d), _profiles(spark, d)).select("namespace", "label", "best_score")


@query("d9_mint_id", "SELECT vec_id, 'Speaker_' || substr(sha256(array_to_string(list_transform(embedding::DOUBLE[], lambda x: round(x * 1000000)::BIGINT::VARCHAR), ',')), 1, 8) AS speaker_id FROM embeddings")
def _(spark, d):
    return _vectors(spark, d).select("vec_id", speakers.mint_id(F.col("vector")).alias("speaker_id"))


@query("d10_update_profiles", f"""WITH pr AS (WITH {_CENTER.format(key='ns, label', where='WHERE vec_id % 2 = 0')} SELECT ns, label, v, (SELECT count(*) FROM embeddings e WHERE e.vec_id % 2 = 0 AND e.vec_id % 3 = u.ns AND e.label = u.label) AS n FROM u),
nw AS (WITH {_CENTER.format(key='ns, label', where='WHERE vec_id % 2 = 1')} SELECT ns, label, list_transform(v, lambda x: x * 3) AS w FROM u WHERE label % 2 = 0), j AS (SELECT ns, label, n, v, w FROM pr FULL JOIN nw USING (ns, label)),
k AS (SELECT *, CASE WHEN w IS NULL THEN v WHEN v IS NULL THEN w ELSE list_transform(v, lambda x, i: x * n + w[i]) END AS z FROM j)
SELECT 'n' || ns AS namespace, 'P' || label AS speaker_id, coalesce(n, 0) + CASE WHEN w IS NULL THEN 0 ELSE 3 END AS member_count, list_transform(z, lambda x: round(x / sqrt(list_sum(list_transform(z, lambda y: y * y))), 5) + 0.0::DOUBLE) AS centroid, CASE WHEN w IS NULL THEN {EPOCH} ELSE {EPOCH + 60} END::INTEGER AS updated FROM k""")
def _(spark, d):
    found = _new(spark, d).filter("label % 2 = 0").select("namespace", F.concat(F.lit("P"), F.col("label").cast("string")).alias("speaker_id"), F.transform("centroid", lambda x: x * 3).alias("vector_sum"), F.lit(3).cast("long").alias("members"))
    u = speakers.update_profiles(_profiles(spark, d), found, EPOCH + 60)
    return u.select("namespace", "speaker_id", "member_count", F.transform("centroid", lambda x: F.round(x, 5) + F.lit(0.0)).alias("centroid"), "updated")


@query("d11_match_profiles", f"""WITH b AS (WITH {_CENTER.format(key='ns, label', where='WHERE vec_id % 2 = 0')} SELECT ns, label, v FROM u), s AS (SELECT e.vec_id // 6 AS query_id, 'P' || label AS speaker_id, max(list_cosine_similarity(e.embedding::DOUBLE[], b.v)) AS score FROM (SELECT vec_id, embedding FROM embeddings) e JOIN b ON e.vec_id % 3 = b.ns GROUP BY ALL)
SELECT query_id, rank::INTEGER AS rank, speaker_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, speaker_id) AS rank FROM s WHERE score >= 0.5) WHERE rank <= 5""")
def _(spark, d):
    turns = _vectors(spark, d).select(F.floor(F.col("vec_id") / 6).alias("query_id"), F.concat(F.lit("n"), (F.col("vec_id") % 3).cast("string")).alias("namespace"), "vector")
    return speakers.match_profiles(turns, _profiles(spark, d))
