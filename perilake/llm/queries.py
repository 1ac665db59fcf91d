"""The registered queries of the operators, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from perilake.llm import chat, exact_dedup, leaks, line_dedup, near_dedup, pii, pivots, quality, repair, subwords, toxicity, warc, whitening
from perilake.llm.shared import fresh_path, table

#: Where the public vocabulary lies on the driver's machine.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SQL: dict[str, str] = {}


def op1_leaks(spark, sf_dir):
    """All occurrences of benchmark items in the documents, up to a fifth of the words edited."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_windows(spark, sf_dir):
    """Every document without passages of three lines that occurred before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated_lines(docs)


SQL["op2_line_windows"] = """
WITH line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
filled AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS t FROM line WHERE t <> ''),
win AS (SELECT doc_id, i, lead(i, 1) OVER w AS i2, lead(i, 2) OVER w AS i3,
               t || chr(10) || lead(t, 1) OVER w || chr(10) || lead(t, 2) OVER w AS body
        FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT * FROM win WHERE body IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, i FROM later UNION SELECT doc_id, i2 FROM later UNION SELECT doc_id, i3 FROM later),
made AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.i IS NULL) AS text,
                count(gone.i) AS n_removed
         FROM line LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CASE WHEN documents.text IS NOT NULL THEN coalesce(made.text, '') END AS text,
       coalesce(n_removed, 0) AS n_removed
FROM documents LEFT JOIN made USING (doc_id)"""


def op3_near_dedup(spark, sf_dir):
    """Near-duplicate group of every document on four-word shingles."""
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), size=4, percent=80)


SQL["op3_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
             ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))
             END AS shingles FROM w),
one AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS common
           FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared WHERE 100 * common >= 80 * (total - common)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION
          SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.other = edge.a)
SELECT s.doc_id, len(any_value(shingles)) AS n_shingles, min(other) AS component_id, s.doc_id = min(other) AS kept
FROM s JOIN reach ON s.doc_id = reach.doc_id GROUP BY s.doc_id"""


def op4_chat_windows(spark, sf_dir):
    """All conversations in budgeted windows, and what is read back from them."""
    control = spark.sql("""SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text
                           FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)""")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    return chat.digests(chat.formatted(turns))


SQL["op4_chat_windows"] = r"""
WITH raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
             SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
num AS (SELECT *, 12 + strlen(e(role)) + 1 + strlen(e(text)) + 11 AS size,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM raw),
sys AS (SELECT *, pos = 1 AND role = 'system' AS system FROM num),
line AS (SELECT *, sum(CASE WHEN system THEN 0 ELSE size END) OVER (PARTITION BY conv_id ORDER BY pos) AS stop,
                greatest(256, (2048 - 256 - max(CASE WHEN system THEN size ELSE 0 END) OVER (PARTITION BY conv_id)) // 2)
                AS stride,
                12 + length(e(role)) + 1 + length(e(text)) + 11 AS chars FROM sys),
placed AS (SELECT *, 2 * ((stop - size) // stride) + CASE WHEN size > stride THEN 1 ELSE 0 END AS w FROM line),
win AS (SELECT conv_id, w, min(stop - size) AS at FROM placed WHERE NOT system GROUP BY ALL),
all_chars AS (SELECT conv_id, chars FROM placed WHERE NOT system UNION ALL
              SELECT p.conv_id, p.chars FROM placed p JOIN win ON p.conv_id = win.conv_id
              AND NOT p.system AND p.stop <= win.at AND p.stop - p.size >= win.at - 256 UNION ALL
              SELECT p.conv_id, p.chars FROM placed p LEFT JOIN win ON p.conv_id = win.conv_id WHERE p.system),
total AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM all_chars GROUP BY ALL)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(CAST(sum(length(text)) FILTER (WHERE role = 'assistant') AS BIGINT), 0) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       any_value(formatted_chars) AS formatted_chars
FROM sys JOIN total USING (conv_id) GROUP BY conv_id"""
for _name in ("role", "text"):
    _escaped = f"replace({_name}, '\\', '\\\\')"
    for _plain, _broken in chat.CONTROLS:
        _escaped = f"replace({_escaped}, '{_plain}', '{_broken}')"
    SQL["op4_chat_windows"] = SQL["op4_chat_windows"].replace(f"e({_name})", _escaped)


def op5_pii(spark, sf_dir):
    """Personal data and disclosing terms in every document."""
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_subwords(spark, sf_dir):
    """Token ids of every document, and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return subwords.encode_checked(docs, VOCABULARY).withColumn("n_tokens", F.size("ids").cast("long"))


def op7_exact_dedup(spark, sf_dir):
    """Group of equal texts of every document, by composable fingerprints."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


SQL["op7_exact_dedup"] = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t"""

def op8_warc(spark, sf_dir):
    """All pages through an archive, its deduplicated rewrite, and resolution of the revisits."""
    crawl, slim = fresh_path(spark, "crawl"), fresh_path(spark, "slim")
    warc.write(warc.captured(table(spark, sf_dir, "pages")), crawl)
    warc.write(warc.deduplicated(warc.read(spark, crawl)), slim)
    return warc.resolved(warc.read(spark, slim)).select(
        F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("original_id").alias("refers_to"))


SQL["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages)
SELECT page_id, strlen(body) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           (('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31
           AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
FROM p WINDOW same AS (PARTITION BY body)"""


def op9_quality(spark, sf_dir):
    """Quality of every document by positive-unlabelled learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_toxicity(spark, sf_dir):
    """Toxicity of every document by compression distance."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), folds=4, held=2)


def op11_conversation_repair(spark, sf_dir):
    """Faults and cheapest repair of every conversation, after damage by a checksum."""
    conversations = table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(conversations), conversations)


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _insert(x: str, name: str) -> str:
    return f"{{'c': {x}.c + 5, 'a': {x}.a || 'I', 'd': {x}.d || '{name}:' || chr(10)}}"


def _take(x: str, initial: str, name: str) -> str:
    return f"""CASE WHEN r.gone THEN {{'c': 1000000000, 'a': '', 'd': ''}}
      WHEN r.i = '{initial}' THEN {{'c': {x}.c + r.pen, 'a': {x}.a || 'K', 'd': {x}.d || r.role || ':' || r.text || chr(10)}}
      ELSE {{'c': {x}.c + r.pen + 1, 'a': {x}.a || 'R', 'd': {x}.d || '{name}:' || r.text || chr(10)}} END"""


def _delete(x: str) -> str:
    return f"{{'c': {x}.c + 2, 'a': {x}.a || 'D', 'd': {x}.d}}"


_GROW = f"""lambda g: {{'s0': g.s0, 's1': g.s1,
   's2': {_least('g.s2', _insert('g.s0', 'user'), _insert('g.s1', 'user'), _insert('g.s3', 'user'))},
   's3': {_least('g.s3', _insert('g.s2', 'assistant'))}}}"""
_GROWN = f"list_transform(list_transform([acc], {_GROW}), {_GROW})"
_SYSTEM = "CASE WHEN r.i = 's' THEN " + _take("g.s0", "s", "") + " ELSE {'c': 1000000000, 'a': '', 'd': ''} END"
_STEP = f"""lambda g: {{'s0': {_delete('g.s0')}, 's1': {_least(_delete('g.s1'), _SYSTEM)},
   's2': {_least(_delete('g.s2'), *(_take(f'g.s{k}', 'u', 'user') for k in (0, 1, 3)))},
   's3': {_least(_delete('g.s3'), _take('g.s2', 'a', 'assistant'))}}}"""
_NONE = "{'c': 1000000000, 'a': '', 'd': ''}"
# A checksum bit by bit, then a fold over each conversation's rows that keeps the least (cost, audit) of four states.
SQL["op11_conversation_repair"] = f"""
WITH keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
               FROM conversations),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_transform(string_split(k, ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
    lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[],
      lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295), 4294967295) % 20 AS kind
  FROM keyed),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM raw WHERE kind <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS i,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt),
flagged AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair, CASE WHEN bare = '' THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
  WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM num),
conv AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{'i': i, 'role': role, 'text': text, 'gone': fault IN ('blank', 'duplicate'),
        'pen': CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END}} ORDER BY pos) AS rows
  FROM flagged GROUP BY conv_id),
ends AS (SELECT *, list_reduce(rows, lambda acc, r: list_transform({_GROWN}, {_STEP})[1],
  {{'s0': {{'c': 0, 'a': '', 'd': ''}}, 's1': {_NONE}, 's2': {_NONE}, 's3': {_NONE}}}) AS acc FROM conv),
grown AS (SELECT *, {_GROWN}[1] AS g FROM ends),
best AS (SELECT *, list_min([g.s0, g.s3]) AS b FROM grown)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost,
  coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.d, 1, greatest(length(b.d) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id"""


def op12_whitening(spark, sf_dir):
    """Whitened coordinates of every embedding in four components."""
    return whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_pivot_search(spark, sf_dir):
    """The five embeddings of largest inner product for every fiftieth one, out of all."""
    return pivots.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL["op13_pivot_search"] = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pairs AS (SELECT q.row AS q_row, q.vec_id AS query_id, c.vec_id, c.row, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row <> c.row)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY q_row ORDER BY score DESC, vec_id, row) QUALIFY row_number() OVER w <= 5"""

QUERIES = {
    "op1_leaks": op1_leaks,
    "op2_line_windows": op2_line_windows,
    "op3_near_dedup": op3_near_dedup,
    "op4_chat_windows": op4_chat_windows,
    "op5_pii": op5_pii,
    "op6_subwords": op6_subwords,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_whitening": op12_whitening,
    "op13_pivot_search": op13_pivot_search,
}
