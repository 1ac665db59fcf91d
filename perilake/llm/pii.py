r"""Personal data: base patterns, and terms that disclose a protected value.

Base spans are found by four patterns with DataFrame functions. Java's engine gives the
matches of a pattern and the text between them; their lengths give places.

A term is a run of two or more letters. Seen within ``WINDOW`` characters of a value, it
discloses the value if it tells most of what there is to know about it:

    I(value; term) = log2(N * n(value, term) / (n(value) * n(term))) >= alpha * log2(N / n(value))

where N counts documents, n(value) documents with the value, n(term) documents with the
term anywhere in the text, and n(value, term) documents with the term in the window of the
value. Rare words share documents with rare values by chance, so one of these must hold too:

* The value stands in ``MIN_DOCS`` or more passages with the term, and chance does not
  explain it: by Chernoff's bound, at most ``CHANCE`` pairs of any value and any term would
  reach that number if terms were strewn over the documents. Documents in which the value
  has the same ``REACH`` characters on both sides (copies) are one passage.
* The term stands within ``REACH`` of the value, which weighs as ``NEAR`` passages, and no
  document has it without the value. Such a term is cut in documents with the value only.

Disclosing terms become spans wherever they stand, in every text: removed at ``REMOVE``
and above, generalised to their first letter below. Work is linear in a text's length.

Counts are exact and over all documents. A term or value that very many documents share
costs a partial row per task; joins on terms and values are split where they are hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilake.llm.shared import cut, free, largest_frame_bytes

#: Kinds in the order of the list of spans, with their patterns: fixed values of the
#: contract. A match starts where no earlier match could go on, which keeps the search
#: linear; possessive loops need no stack. A chain of digits is taken whole, so for cards
#: only chains of 14 to 19 digits are matched, not all and then filtered.
KINDS = ["email", "ip", "card", "phone", "term"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A character without which a kind can't match, to pass over most texts.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+"}
MARKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"\p{L}[\p{L}\p{M}]++"
REACH, WINDOW, MIN_DOCS, NEAR, ALPHA, REMOVE, CHANCE = 48, 512, 3, 3, 0.8, 0.95, 0.05
#: Bytes of disclosing terms that are broadcast; more of them are joined with a shuffle.
BROADCAST_BYTES = 16 << 20
NULL_ID = -(1 << 63)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    value = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


FOUND = "array<struct<start:int,end:int,value:string>>"
#: Matches of a text that are placed at a time.
STEP = 64


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, not again wherever a lambda names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern in order: an array of start, end (code points) and value.

    Places are running sums of the lengths of gaps and matches, made in steps and then
    over steps, as an array is copied for each element put to it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    pairs = _bound(found, lambda m: F.arrays_zip(F.slice(gaps, F.lit(1), F.size(m)).alias("gap"), m.alias("value")))
    length = lambda step: F.aggregate(step, F.lit(0), lambda n, p: n + p["gap"] + F.char_length(p["value"]))

    def in_steps(all_pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / STEP).cast("int")),
                           lambda i: F.slice(all_pairs, i * STEP + 1, F.lit(STEP)))

    def begun(steps: Column) -> Column:
        return F.aggregate(
            steps, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda s, step: F.struct((s["at"] + length(step)).alias("at"), F.array_append(s["all"], s["at"]).alias("all")),
            lambda s: s["all"])

    def placed(step: Column, at: Column) -> Column:
        def put(s: Column, p: Column) -> Column:
            start = s["at"] + p["gap"]
            end = start + F.char_length(p["value"])
            return F.struct(end.alias("at"), F.array_append(s["all"], F.struct(
                start.alias("start"), end.alias("end"), p["value"].alias("value"))).alias("all"))

        return F.aggregate(step, F.struct(at.alias("at"), F.array().cast(FOUND).alias("all")), put, lambda s: s["all"])

    whole = _bound(pairs, lambda x: F.when(F.size(x) > 0, _bound(in_steps(x), lambda steps: F.flatten(
        F.zip_with(steps, begun(steps), placed)))).otherwise(F.array().cast(FOUND)))
    return F.coalesce(whole, F.array().cast(FOUND))


def _spans(text: Column, rank: int, kind: str) -> Column:
    found = F.when(text.rlike(NEEDS[kind]), located(text, PATTERNS[kind])).otherwise(F.array().cast(FOUND))
    return F.transform(F.filter(found, lambda x: _valid(kind, x["value"])), lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"),
        x["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """All base spans of a text: an array of start, rank, kind, end and value, sorted."""
    return F.sort_array(F.concat(*[_spans(text, rank, kind) for rank, kind in enumerate(KINDS[:4])]))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _beside(text: Column, spans: Column, window: int, reach: int) -> Column:
    """What stands around each span: an array of value, context (a hash of ``reach`` characters
    on both sides) and terms (distinct whole terms of the window, with the least distance)."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{window}}}+"), F.lit(0))

    def around(s: Column, blocks: Column) -> Column:
        # A piece more on both sides shows whether a term at the edge goes on.
        first = F.greatest(F.floor(s["start"] / window) - 2, F.lit(0)).cast("int")
        part = F.array_join(F.slice(blocks, first + 1, F.floor(s["end"] / window).cast("int") + 3 - first), "")
        start, end = s["start"] - first * window, s["end"] - first * window
        left, right = F.substring(part, F.lit(1), start), F.substring(part, end + 1, F.char_length(part))
        near = lambda side, away: F.transform(
            F.filter(F.transform(located(side, TERM), lambda t: F.struct(F.lower(t["value"]).alias("term"), away(t).alias("away"))),
                     lambda t: t["away"] <= window), lambda t: F.struct(t["term"].alias("term"), (t["away"] <= reach).alias("near")))
        terms = F.concat(near(left, lambda t: start - t["start"]), near(right, lambda t: t["end"]))
        return F.struct(
            F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("value"),
            F.xxhash64(F.substring(left, F.greatest(start - reach, F.lit(0)) + 1, F.lit(reach)),
                       F.substring(right, F.lit(1), F.lit(reach))).alias("context"),
            F.array_distinct(terms).alias("terms"))

    return _bound(pieces, lambda blocks: F.transform(spans, lambda s: around(s, blocks)))


def _first_below(items: Column, below) -> Column:
    """How many first elements of an array pass a test that no later element passes, by bisection."""
    steps = F.array(*[F.lit(1 << bit) for bit in range(26, -1, -1)])
    return F.aggregate(F.filter(steps, lambda step: step <= F.size(items)), F.lit(0),
                       lambda low, step: F.when(below(F.get(items, low + step - 1)), low + step).otherwise(low))


def _words(body: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(TERM), F.lit(0)), F.lower))


def disclosing(held: DataFrame, texts: DataFrame, min_docs: int = MIN_DOCS, alpha: float = ALPHA,
               chance: float = CHANCE) -> DataFrame:
    """Terms that disclose a value, with the largest share of a value's information.

    ``held`` has row_id, row_hash and beside of documents with values, ``texts`` has body.
    """
    n_docs = float(texts.count())
    # Counted before the join: a row per term and task, whatever terms are asked for.
    n_term = cut(texts.select(F.explode(_words(F.col("body"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")))
    spots = cut(held.withColumn("copy", F.monotonically_increasing_id()).select("copy", "row_id", "row_hash", F.inline("beside")))
    each = spots.groupBy("copy", "value").agg(
        F.min("context").alias("context"), F.first("row_id").alias("row_id"), F.first("row_hash").alias("row_hash"))
    # Of copies of a passage, the row with the smallest id speaks for all.
    passages = each.groupBy("value", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("row_id", "row_hash", "copy")).alias("speaker"))
    values = cut(passages.groupBy("value").agg(F.sum("n").alias("n_value"), F.count("*").alias("n_passages")))
    chances = F.log(F.lit(float(max(values.count(), 1)) * max(n_term.count(), 1)))
    speakers = passages.select("value", F.col("speaker.copy").alias("copy"), F.lit(1).alias("speaks"))
    known = spots.select("copy", "value", "terms").join(speakers, ["copy", "value"], "left").join(values, "value")
    pairs = known.select("copy", "value", F.coalesce("speaks", F.lit(0)).alias("speaks"), "n_value", "n_passages", F.inline("terms")) \
        .groupBy("copy", "value", "term", "speaks", "n_value", "n_passages").agg(F.max("near").cast("int").alias("near"))
    # n_both is at most n_value, so a more frequent term can't reach the threshold; the factor is for rounding.
    most = F.pow("n_value", F.lit(alpha)) * F.pow(F.lit(n_docs), F.lit(1 - alpha)) * (1 + 1e-9)
    both = pairs.join(n_term, "term").filter(F.col("n_term") <= most).groupBy("value", "term", "n_value", "n_passages", "n_term") \
        .agg(F.count("*").alias("n_both"), F.sum("speaks").alias("n_seen"), F.sum("near").alias("n_near"))
    told = F.log2(F.lit(n_docs) * F.col("n_both") / (F.col("n_value") * F.col("n_term")))
    whole = F.log2(F.lit(n_docs) / F.col("n_value"))
    by_chance = F.col("n_passages") * F.col("n_term") / F.lit(n_docs)
    log_chance = F.col("n_seen") - by_chance - F.col("n_seen") * F.log(F.col("n_seen") / by_chance)
    seen = (F.col("n_seen") >= min_docs) & (F.col("n_seen") > by_chance) & (log_chance + chances <= F.log(F.lit(chance)))
    only = (F.col("n_near") > 0) & (F.col("n_both") == F.col("n_term")) \
        & (F.col("n_seen") + (NEAR - 1) * F.col("n_near") >= min_docs)
    return both.withColumn("share", F.when(whole > 0, told / whole).otherwise(0.0)) \
        .filter((F.col("share") >= alpha) & (seen | only)).groupBy("term").agg(F.max("share").alias("share"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH,
               min_docs: int = MIN_DOCS, alpha: float = ALPHA, window: int = WINDOW, chance: float = CHANCE) -> DataFrame:
    """Base spans and disclosing terms of each row: row_id, row_hash, spans, terms.

    ``spans`` holds start, rank, kind, end and value; ``terms`` holds start, end and share,
    of terms that no base span overlaps. Repeated rows count as documents of their own
    and get the same spans; null texts count as empty; rows are told apart by the id and
    a hash of the text, so that ids may be null or repeated.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("row_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.withColumn("row_hash", F.xxhash64("body"))
    found = rows.withColumn("spans", base_spans(F.col("body"))).select(
        "row_id", "row_hash", "spans", F.when(F.size("spans") > 0, _beside(F.col("body"), F.col("spans"), window, reach)).alias("beside"))
    found = cut(found)
    held = found.filter(F.size("spans") > 0)
    telling = cut(disclosing(held, rows, min_docs, alpha, chance))
    if largest_frame_bytes(telling, "term") <= BROADCAST_BYTES:
        telling = F.broadcast(telling)
    # Which terms a text has is found without its places; only texts with some are searched for places.
    hits = rows.select("row_id", "row_hash", F.explode(_words(F.col("body"))).alias("term")).join(telling, "term") \
        .groupBy("row_id", "row_hash").agg(F.sort_array(F.collect_set(F.struct("term", "share"))).alias("telling"))

    def told(term: Column) -> Column:
        return F.get("telling", _first_below(F.col("telling"), lambda x: x["term"] <= term) - 1)

    looked = F.transform(located(F.col("body"), TERM), lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"),
        _bound(F.lower(t["value"]), lambda term: _bound(told(term), lambda x: F.when(x["term"] == term, x["share"]))).alias("share")))
    placed = F.filter(looked, lambda t: t["share"].isNotNull())
    places = rows.join(hits, ["row_id", "row_hash"]).select("row_id", "row_hash", placed.alias("terms")) \
        .groupBy("row_id", "row_hash").agg(F.min("terms").alias("terms"))
    # Spans of one kind don't overlap: only the last one that starts before a term's end can reach into it.
    kinds = F.transform(F.array(*[F.lit(kind) for kind in KINDS[:4]]), lambda kind: F.filter(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))),
        lambda s: s["kind"] == kind))
    reached = lambda t, of: F.coalesce(F.get(
        of, _first_below(of, lambda s: s["start"] < t["end"]) - 1)["end"] > t["start"], F.lit(False))
    free_of_base = F.when(F.size("terms") > 0, _bound(kinds, lambda each: F.filter(
        "terms", lambda t: ~F.exists(each, lambda of: reached(t, of)))))
    none = F.array().cast("array<struct<start:int,end:int,share:double>>")
    return found.select("row_id", "row_hash", "spans").join(places, ["row_id", "row_hash"], "left") \
        .select("row_id", "row_hash", "spans", F.coalesce(free_of_base, none).alias("terms"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """All rows and columns with personal data taken out of the text.

    Base spans become marks; where several overlap, the first stands for all. Terms
    are removed or left with their first letter. A null text stays null.
    """
    row_id, row_hash = free(docs, "row_id", "row_hash")
    found = find_spans(docs, id_col, text_col, **how).dropDuplicates(["row_id", "row_hash"])
    found = found.select(F.col("row_id").alias(row_id), F.col("row_hash").alias(row_hash),
                         F.struct("spans", "terms").alias("found"))
    text = F.col(f"`{text_col}`")
    keyed = docs.withColumns({row_id: F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)),
                              row_hash: F.xxhash64(F.coalesce(text, F.lit("")))})
    both = keyed.join(found, [row_id, row_hash], "left")
    mark = lambda s: F.coalesce(*[F.when(s["kind"] == k, m) for k, m in MARKS.items()])
    edits = F.sort_array(F.concat(
        F.transform(F.col("found.spans"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), mark(s).alias("put"))),
        F.transform(F.col("found.terms"), lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"),
            F.when(t["share"] >= REMOVE, "").otherwise(F.concat(F.substring(text, t["start"] + 1, F.lit(1)), F.lit("."))).alias("put")))))

    def step(s: Column, e: Column) -> Column:
        more = F.array(F.substring(text, s["at"] + 1, e["start"] - s["at"]), e["put"])
        return F.struct(F.greatest(s["at"], e["end"]).alias("at"),
                        F.when(e["start"] >= s["at"], F.concat(s["out"], more)).otherwise(s["out"]).alias("out"))

    done = F.aggregate(edits, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
    clean = F.when((F.size("found.spans") > 0) | (F.size("found.terms") > 0), F.concat(
        F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.char_length(text)))).otherwise(text)
    return both.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Counts and lists of spans of each row, base ones and all."""
    found = find_spans(docs, id_col, text_col, **how)
    terms = F.transform("terms", lambda t: F.struct(
        t["start"].alias("start"), F.lit(4).alias("rank"), F.lit("term").alias("kind"), t["end"].alias("end"),
        F.lit("").alias("value")))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.nullif("row_id", F.lit(NULL_ID)).alias(id_col), *[count(k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(listed(F.col("spans")), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("spans", terms))).alias("spans"))
