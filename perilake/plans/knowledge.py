"""Text chunks, the vector store and batch retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from perilake.functions.numeric import round_to
from perilake.operators import chunks as chunking, retrieval, vectors
from perilake.plans import reports
from perilake.plans.catalog import plan
from perilake.plans.checksql import over_both, over_motor
from perilake.sources.tables import spread

K = 6


def profiles(lake) -> dict[str, DataFrame]:
    motor = lake.gold("motor")
    return {
        "motor": reports.motor_profile(motor),
        "motor_make": reports.make_profile(motor),
        "claims_age": reports.driver_profile(lake.silver("claims")),
        "claims_risk": reports.tier_profile(lake.gold("claims")),
    }


_PROFILE_SQL = {
    "motor": reports.MOTOR_PROFILE_SQL,
    "motor_make": reports.MAKE_PROFILE_SQL,
    "claims_age": reports.DRIVER_PROFILE_SQL,
    "claims_risk": reports.TIER_PROFILE_SQL,
}


def _shown(name: str, fmt: str) -> str:
    return f"coalesce({name if fmt == '%s' else f'printf({fmt!r}, {name})'}, 'unknown')"


def _chunk_sql(source: str) -> str:
    pieces = chunking.TEMPLATES[source].replace("}", "{").split("{")
    text = " || ".join(
        _shown(p, chunking.FORMATS.get(p, "%s")) if i % 2 else f"'{p}'" for i, p in enumerate(pieces) if p
    )
    escaped = "coalesce(replace(replace(CAST({} AS VARCHAR), '%', '%25'), '/', '%2F'), '%')"
    key = " || '/' || ".join([f"'{source}'", *[escaped.format(k) for k in chunking.KEYS[source]]])
    return f"SELECT {key} AS chunk_id, '{source}' AS source, {text} AS text FROM ({_PROFILE_SQL[source]})"


_CHUNKS = "chunks AS (" + " UNION ALL ".join(_chunk_sql(s) for s in chunking.TEMPLATES) + ")"


def all_chunks(lake) -> DataFrame:
    return lake.stored("gold", "chunks", lambda: chunking.all_chunks(profiles(lake)))


@plan("c16_motor_sentences", over_motor(_chunk_sql("motor")))
def c16(lake):
    return chunking.chunk(reports.motor_profile(lake.gold("motor")), "motor")


@plan("u02_all_chunks", over_both("SELECT chunk_id, source, text FROM chunks", _CHUNKS))
def u02(lake):
    return chunking.all_chunks(profiles(lake))


# --- vectors -----------------------------------------------------------------

_HEX = "0123456789abcdef"


def _terms(name: str, source: str, key: str) -> str:
    slot = " + ".join(f"(strpos('{_HEX}', h[{i + 1}]) - 1) * {16 ** (2 - i)}" for i in range(3))
    return f"""{name}_words AS (SELECT {key} AS id, substr(md5(w), 1, 3) AS h FROM (
      SELECT {key}, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {source}) WHERE w <> ''),
    {name}_terms AS (SELECT id, {slot} AS slot, count(*) AS n FROM {name}_words GROUP BY ALL)"""


def _vectors(name: str, source: str, key: str, corpus: str, corpus_source: str) -> str:
    """Dense unit vectors (id, pos, w), weights taken from the corpus terms."""
    return f"""{name}_raw AS (
      SELECT t.id, slot % 64 AS pos, sum(CASE WHEN (slot // 64) % 2 = 0 THEN 1 ELSE -1 END * n * ln(
        ((SELECT count(*) FROM {corpus_source}) + 1)::DOUBLE / (coalesce(d.n_docs, 0) + 1))) AS v
      FROM {name}_terms t LEFT JOIN
        (SELECT slot AS s, count(*) AS n_docs FROM {corpus}_terms GROUP BY slot) d ON d.s = t.slot
      GROUP BY ALL),
    {name}_vec AS (SELECT k.{key} AS id, p.pos, CAST(coalesce(v / nullif(norm, 0), 0) AS FLOAT) AS w
      FROM {source} k CROSS JOIN (SELECT unnest(range(64)) AS pos) p
      LEFT JOIN {name}_raw r ON r.id = k.{key} AND r.pos = p.pos
      LEFT JOIN (SELECT id, sqrt(sum(v * v)) AS norm FROM {name}_raw GROUP BY id) m ON m.id = k.{key})"""


def _nearest(question: str, corpus: str, k: int) -> str:
    return f"""hits AS (SELECT * FROM (
      SELECT question_id, chunk_id, distance,
        CAST(row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS INTEGER) AS rank
      FROM (SELECT q.id AS question_id, c.id AS chunk_id,
          round(sum((q.w::DOUBLE - c.w::DOUBLE) * (q.w::DOUBLE - c.w::DOUBLE)), 9) AS distance
        FROM {question}_vec q JOIN {corpus}_vec c USING (pos) GROUP BY ALL)) WHERE rank <= {k})"""


def _rounded_entries(df: DataFrame, *keep: str) -> DataFrame:
    entries = df.select(*keep, F.posexplode("embedding").alias("pos", "w"))
    return entries.select(*keep, "pos", round_to(F.col("w"), 5).alias("weight"))


_DOC_VECTORS = (_terms("doc", "documents", "doc_id"), _vectors("doc", "documents", "doc_id", "doc", "documents"))


@plan(
    "v01_embed_text",
    "WITH "
    + ", ".join(_DOC_VECTORS)
    + " SELECT id AS doc_id, CAST(pos AS INTEGER) AS pos, round(w::DOUBLE, 5) AS weight FROM doc_vec",
)
def v01(lake):
    return _rounded_entries(document_vectors(lake), "doc_id")


def documents(lake) -> DataFrame:
    return spread(lake.table("documents").select("doc_id", "text"))


def document_embedder(lake):
    return lake.model("document_embedder", lambda: vectors.fit_embedder(documents(lake)))


def document_vectors(lake) -> DataFrame:
    def build():
        return vectors.embed_text(documents(lake), document_embedder(lake), keep=["doc_id"])

    return lake.stored("gold", "document_vectors", build)


def chunk_embedder(lake):
    return lake.model("chunk_embedder", lambda: vectors.fit_embedder(all_chunks(lake)))


def vector_store(lake) -> DataFrame:
    """Chunks with their vectors in one table, so no position links them."""
    return lake.stored("gold", "vector_store", lambda: vectors.embed_text(all_chunks(lake), chunk_embedder(lake)))


_CHUNK_VECTORS = (_CHUNKS, _terms("chunk", "chunks", "chunk_id"), _vectors("chunk", "chunks", "chunk_id", "chunk", "chunks"))


@plan(
    "a10_vector_store",
    over_both(
        """SELECT chunk_id, source, text, CAST(pos AS INTEGER) AS pos, round(w::DOUBLE, 5) AS weight
        FROM chunk_vec JOIN chunks ON chunk_id = id""",
        *_CHUNK_VECTORS,
    ),
)
def a10(lake):
    return _rounded_entries(vector_store(lake), "chunk_id", "source", "text")


# --- retrieval ---------------------------------------------------------------


def centroids(embeddings: DataFrame) -> DataFrame:
    """One question per label: the mean vector of the label."""
    entries = embeddings.select("label", F.posexplode("embedding").alias("pos", "w"))
    means = entries.groupBy("label", "pos").agg(F.avg(F.col("w").cast("double")).alias("m"))
    rounded = means.withColumn("m", round_to(F.col("m"), 6))
    gathered = rounded.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("e"))
    return gathered.select(
        F.col("label").cast("bigint").alias("question_id"),
        F.transform("e", lambda e: e["m"].cast("float")).alias("embedding"),
    )


_CENTROID_HITS = """c_vec AS (
    SELECT vec_id AS id, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS w FROM embeddings),
q_vec AS (SELECT CAST(label AS BIGINT) AS id, pos, CAST(round(avg(w::DOUBLE), 6) AS FLOAT) AS w
    FROM c_vec JOIN embeddings ON vec_id = id GROUP BY label, pos), """


@plan(
    "v02_nearest_vectors",
    "WITH " + _CENTROID_HITS + _nearest("q", "c", K) + " SELECT question_id, chunk_id AS vec_id, rank, distance FROM hits",
)
def v02(lake):
    corpus = lake.table("embeddings")
    return vectors.knn(centroids(corpus), corpus, K, corpus_id="vec_id")


_ITEMS = "items AS (SELECT item_id, text FROM benchmark)"


@plan(
    "v03_nearest_documents_by_blocks",
    "WITH "
    + ", ".join(
        [
            *_DOC_VECTORS,
            _ITEMS,
            _terms("item", "items", "item_id"),
            _vectors("item", "items", "item_id", "doc", "documents"),
            _nearest("item", "doc", K),
        ]
    )
    + " SELECT question_id, chunk_id AS doc_id, rank, distance FROM hits",
)
def v03(lake):
    items = lake.table("benchmark").select(F.col("item_id").alias("question_id"), "text")
    asked = vectors.embed_text(items, document_embedder(lake), keep=["question_id"])
    return vectors.knn_grid(asked, document_vectors(lake), K, corpus_id="doc_id")


def questions(lake) -> DataFrame:
    return lake.table("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def asked_vectors(lake) -> DataFrame:
    texts = questions(lake).withColumnRenamed("question", "text")
    return vectors.embed_text(texts, chunk_embedder(lake), keep=["question_id"])


def chunk_hits(lake, k: int = K) -> DataFrame:
    return vectors.knn(asked_vectors(lake), vector_store(lake), k)


_CHUNK_SEARCH = (
    *_CHUNK_VECTORS,
    _ITEMS,
    _terms("item", "items", "item_id"),
    _vectors("item", "items", "item_id", "chunk", "chunks"),
)


@plan(
    "j01_hit_lookup",
    over_both(
        "SELECT question_id, rank, chunk_id, source, text FROM hits JOIN chunks USING (chunk_id)",
        *_CHUNK_SEARCH,
        _nearest("item", "chunk", K),
    ),
)
def j01(lake):
    return retrieval.lookup(chunk_hits(lake), all_chunks(lake)).drop("distance")


@plan(
    "j02_question_distance",
    over_both(
        "SELECT question_id, chunk_id, rank, distance FROM hits", *_CHUNK_SEARCH, _nearest("item", "chunk", 1)
    ),
)
def j02(lake):
    return chunk_hits(lake, 1)


_CONTEXT = """contexts AS (SELECT question_id,
  string_agg('[Source: ' || source || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
  FROM hits JOIN chunks USING (chunk_id) GROUP BY question_id)"""


@plan(
    "v04_context",
    over_both("SELECT * FROM contexts", *_CHUNK_SEARCH, _nearest("item", "chunk", K), _CONTEXT),
)
def v04(lake):
    return retrieval.build_context(chunk_hits(lake), all_chunks(lake))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@plan(
    "v05_prompt",
    over_both(
        f"""SELECT question_id, {_literal(retrieval.PROMPT_HEAD)} || context
        || {_literal(retrieval.PROMPT_QUESTION)} || text || {_literal(retrieval.PROMPT_TAIL)} AS prompt
        FROM contexts JOIN items ON item_id = question_id""",
        *_CHUNK_SEARCH,
        _nearest("item", "chunk", K),
        _CONTEXT,
    ),
)
def v05(lake):
    return retrieval.build_prompt(retrieval.build_context(chunk_hits(lake), all_chunks(lake)), questions(lake))
