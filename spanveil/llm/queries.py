"""Registered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import centroids, chosen_path, conversation_repair, decontaminate, exact_dedup, licenses, line_dedup, mixing, paragraphs, private_terms, quality, secrets, token_files
from spanveil.llm.common import read_table, shared_folder
from spanveil.plans.document_sql import hits
from spanveil.plans.sentences import luhn_sql


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it holds, with the alignment's score and place (in words)."""
    found = decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "item_id", "score", F.col("start").alias("first_word"),
        F.col("end").alias("end_word"), "n_seeds",
    )


def op2_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents, with the terms that disclose it."""
    return private_terms.digest_columns(private_terms.personal_spans(read_table(spark, sf_dir, "documents")))


def _personal_data(table: str, key: str, text: str) -> str:
    """SELECT key, k (place of the kind), kind, start, value of every base span."""
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    octet = "CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) END"
    kinds = [
        ("email", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", "true"),
        ("ip", r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)", f"list_max(list_transform(string_split(value, '.'), lambda x: {octet})) <= 255"),
        ("card", r"([0-9](?:[\x20-]?[0-9])+)", f"length({digits}) BETWEEN 13 AND 19 AND {luhn_sql(digits)}"),
        ("phone", r"(\+[0-9][\x20().0-9-]+[0-9])", f"length({digits}) BETWEEN 9 AND 15"),
    ]
    return " UNION ALL ".join(
        f"SELECT {key}, {k} AS k, '{kind}' AS kind, start, value FROM ({hits(table, key, regex, text)}) WHERE {rule}"
        for k, (kind, regex, rule) in enumerate(kinds)
    )


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS ({_personal_data('d', 'doc_id', 'text')}),
l AS (
  SELECT doc_id, doc_id * 10000000 + i AS lid, lines[i] AS line,
         coalesce(list_sum(list_transform(lines[1:i-1], lambda x: length(x) + 1)), 0) AS at
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d) CROSS JOIN UNNEST(range(1, len(lines) + 1)) AS t(i)),
le AS ({_personal_data('l', 'lid', 'line')}),
el AS (SELECT * FROM l WHERE lid IN (SELECT lid FROM le)),
lw AS (
  SELECT w.lid, w.start, w.value, lower(w.value) AS t
  FROM ({hits('el', 'lid', f'({private_terms.ANY_CASE_WORD})', 'line')}) w
  WHERE NOT EXISTS (SELECT 1 FROM le x WHERE x.lid = w.lid AND x.start < w.start + length(w.value) AND w.start < x.start + length(x.value))),
ents AS (SELECT DISTINCT lid, lower(value) AS c FROM le),
n_c AS (SELECT c, count(*) AS n_c FROM ents GROUP BY c),
pairs AS (
  SELECT c, t, count(*) AS n_ct FROM ents JOIN (SELECT DISTINCT lid, t FROM lw) USING (lid) JOIN el USING (lid)
  GROUP BY c, t HAVING count(DISTINCT md5(line)) > 1),
n_t AS (
  SELECT t, count(*) AS n_t
  FROM (SELECT unnest(list_distinct(string_split_regex(lower(line), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS t FROM l)
  WHERE t IN (SELECT t FROM pairs) GROUP BY t),
scored AS (
  SELECT c, t, log2(n * n_ct / (n_c::DOUBLE * n_t)) AS pmi, log2(n / n_c) AS ic
  FROM pairs JOIN n_c USING (c) JOIN n_t USING (t), (SELECT count(*)::DOUBLE AS n FROM l)),
extra AS (
  SELECT el.doc_id, el.at + lw.start AS start, any_value(lw.value) AS value,
         CASE WHEN max(pmi / ic) >= 0.9 THEN 'removed' ELSE 'general' END AS kind
  FROM lw JOIN ents USING (lid) JOIN scored USING (c, t) JOIN el USING (lid) WHERE pmi >= 0.7 * ic GROUP BY el.doc_id, el.at + lw.start),
every AS (
  SELECT doc_id, k, kind, start, value FROM e
  UNION ALL SELECT doc_id, CASE kind WHEN 'general' THEN 4 ELSE 5 END, kind, start, value FROM extra),
told AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card,
         count(*) FILTER (k = 3) AS n_phone,
         string_agg(kind || ':' || start || ':' || (start + length(value)), ',' ORDER BY k, start) FILTER (k < 4) AS base,
         string_agg(kind || ':' || start || ':' || (start + length(value)), ',' ORDER BY k, start) AS spans
  FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id)
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document of the same text that stays. Rows: all; null id or text: see the operator."""
    found = exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


OP3_SQL = r"""
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)
"""


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents: phrases as the base, the rules' labels added."""
    found = licenses.scan_licenses(read_table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_union("base_labels", F.transform("found", lambda f: f["label"])))
    score = F.array_max(F.concat(F.transform("found", lambda f: f["score"]), F.transform("places", lambda _: F.lit(0.6))))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
    )


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies (five-word shingles, Jaccard 0.8) and its number of links."""
    found = chosen_path.near_copies(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies", "class_size", "kept")


OP5_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
shingled AS (
  SELECT doc_id, list_sort(list_distinct(
           CASE WHEN len(w) = 0 THEN []
                ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS s
  FROM worded),
sets AS (
  SELECT min(doc_id) AS rep, s, len(s) AS n, count(*) AS n_copies, list(doc_id) AS docs
  FROM shingled WHERE len(s) > 0 GROUP BY s),
members AS (SELECT rep, n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM members a JOIN members b ON a.x = b.x AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) * 5 >= 4 * (a.n + b.n - count(*))),
reach AS (
  SELECT rep AS a, rep AS b FROM sets
  UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
roots AS (SELECT a AS rep, min(b) AS root FROM reach GROUP BY a),
degrees AS (SELECT a AS rep, count(*) AS n_links FROM pairs GROUP BY a),
labelled AS (
  SELECT unnest(docs) AS doc_id, root, coalesce(n_links, 0) AS n_links, n_copies
  FROM sets JOIN roots USING (rep) LEFT JOIN degrees USING (rep)
  UNION ALL SELECT doc_id, doc_id, 0, 1 FROM shingled WHERE len(s) = 0)
SELECT doc_id, root AS class_id, n_links, n_copies, count(*) OVER (PARTITION BY root) AS class_size, doc_id = root AS kept
FROM labelled
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: three formats as the base, random tokens by the Markov models added."""
    return secrets.digest_columns(secrets.secret_spans(read_table(spark, sf_dir, "documents")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as ORC in id order and read back: place, size and checksum of every document."""
    path = shared_folder(spark, "tokens")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path)
    return token_files.token_index(spark, path)


def op8_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that repeat, exactly or nearly, in stretches of 20 words or more."""
    return paragraphs.repeated_paragraphs(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "para", "start", "end", "n_words", "class_id", "class_size",
        F.col("keep_id").alias("keep_doc_id"), "removed",
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by their nearest labelled neighbours."""
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document when sources are mixed by the weights 5, 2, 1 to 150 % of all words."""
    docs = read_table(spark, sf_dir, "documents")
    m = F.col("mix")
    return mixing.with_copies(docs, mixing.mixing_plan(docs)).select(
        F.col("doc.doc_id").alias("doc_id"), m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"),
        (m["size"] * m["copies"]).alias("taken"),
    )


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE)
           / 281474976710656::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
filled AS (
  SELECT *, coalesce(sum(cap) OVER full_first, 0) AS used,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place,
         (SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER full_first, 0) AS open_weight,
         1.5::DOUBLE * (SELECT sum(source_size) FROM sources) AS total
  FROM sources
  WINDOW full_first AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (
  SELECT coalesce(arg_min((total - used)::DOUBLE / open_weight::DOUBLE, place)
                  FILTER ((total - used)::DOUBLE / open_weight::DOUBLE < cap / weight), 1e300) AS level
  FROM filled),
plan AS (
  SELECT source, source_size, target, rest, certain, rate - certain AS p
  FROM (SELECT *, floor(rate) AS certain, target - floor(rate) * source_size AS rest
        FROM (SELECT source, source_size, least(cap, level * weight) AS target,
                     CASE WHEN source_size > 0 THEN least(cap, level * weight) / source_size ELSE 0 END AS rate
              FROM sources, water))),
ranked AS (
  SELECT s.doc_id, s.size, p.*, floor(u * (1 - p) / (u * (1 - p) + (1 - u) * p) * 68719476736::DOUBLE)::BIGINT AS rnk
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
ties AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rnk) AS upto, sum(size) OVER (PARTITION BY source, rnk) AS own
  FROM ranked)
SELECT doc_id, size, source_size, target,
       (size * (certain + CASE WHEN p > 0 AND upto - own + own / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ties
"""



def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after five rounds of 40 centroids, with exact distances and sums."""
    return centroids.with_inertia(*centroids.clustered(read_table(spark, sf_dir, "embeddings"))).select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _centroid_sql(rounds: int = 5) -> str:
    """The rounds one after another; distances over lists of integers, means by floored division of exact sums."""

    def near(k: int) -> str:
        apart = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        return (
            f"near{k} AS MATERIALIZED (SELECT vec_id, q, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance "
            f"FROM (SELECT v.vec_id, v.q, c.cluster, {apart}::BIGINT AS d FROM kept v, centres{k} c) GROUP BY vec_id, q)"
        )

    steps = []
    for k in range(rounds):
        steps.append(near(k))
        steps.append(
            f"means{k} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q "
            f"FROM (SELECT cluster, i, sum(q[i]) AS s, count(*) AS n FROM near{k}, range(1, 65) AS t(i) GROUP BY cluster, i) "
            f"GROUP BY cluster), "
            f"centres{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM centres{k} c LEFT JOIN means{k} m USING (cluster))"
        )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
centres0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1)::INT AS cluster, q
  FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < 40),
{', '.join(steps)},
{near(rounds)}
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM near{rounds} n JOIN centres{rounds} c USING (cluster)
"""


OP11_SQL = _centroid_sql()


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a checksum: its faults, the cheapest repair and a digest of the repaired turns."""
    rows = conversation_repair.turns(read_table(spark, sf_dir, "conversations"))
    hurt = conversation_repair.damaged(rows)
    plans = conversation_repair.kept(conversation_repair.repair_plans(hurt))
    digests = conversation_repair.repaired_digests(hurt, plans)
    found = plans.join(digests.withColumnRenamed("conv_id", "own"), F.col("conv_id").eqNullSafe(F.col("own")))
    every = rows.select(F.col("conv_id").alias("every_id")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("every_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("every_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _repair_sql() -> str:
    """Suffix by suffix: per state the least (cost, audit, repaired turns) of the rows from a place on."""
    after = {"s": "u", "u": "a", "a": "u", "n": "u"}  # n: no turn yet
    named = {"u": "user", "a": "assistant"}

    def way(cost, audit, out, rest):
        return f"{{'c': {cost} + {rest}.c, 'e': '{audit}' || {rest}.e, 'o': {out} || {rest}.o}}"

    def best(state):
        ways = [way("3", "D", "''", f"f.{state}")]
        turn = f"chr(10) || '{named[after[state]]}' || ':' || r.text"
        ways.append(f"CASE WHEN r.fault IN (0, 3) THEN {way('2 + (r.fault = 3)::INT', 'R', turn, 'f.' + after[state])} END")
        for initial in [after[state]] + (["s"] if state == "n" else []):
            own = way("(r.fault = 3)::INT", "K", "chr(10) || r.role || ':' || r.text", "f." + initial)
            ways.append(f"CASE WHEN r.fault IN (0, 3) AND r.initial = '{initial}' THEN {own} END")
        return f"list_min([{', '.join(ways)}]) AS {state}"

    def with_inserts(state):
        one, two = after[state], after[after[state]]
        turn = lambda t: f"chr(10) || '{named[t]}:'"
        ways = [f"b.{state}", way("2", "I", turn(one), f"b.{one}"), way("4", "II", f"{turn(one)} || {turn(two)}", f"b.{two}")]
        return f"list_min([{', '.join(ways)}]) AS {state}"

    states = ("n", "s", "u", "a")
    done, never = "{'c': 0::BIGINT, 'e': '', 'o': ''}", "{'c': 1000000::BIGINT, 'e': '', 'o': ''}"
    ends = ", ".join(f"{done if state in 'na' else never} AS {state}" for state in states)
    return rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hit AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
      lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS h
  FROM src),
hurt AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit CROSS JOIN UNNEST(CASE h WHEN 3 THEN [1, 2] ELSE [1] END) WHERE h <> 0),
placed AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM hurt),
rows AS (
  SELECT conv_id, turn, role, text, initial, i, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 1
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
              WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 3
              ELSE 0 END AS fault
  FROM placed),
told AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id),
best AS (
  SELECT conv_id, i, {', '.join(with_inserts(s) for s in states)}
  FROM (SELECT conv_id, n + 1 AS i, {ends} FROM told) b
  UNION ALL
  SELECT conv_id, i, {', '.join(with_inserts(s) for s in states)}
  FROM (SELECT r.conv_id, r.i, {', '.join(best(s) for s in states)}
        FROM best f JOIN rows r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i - 1) b)
SELECT s.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.n.c, 0) AS cost,
       coalesce(b.n.e, '') AS audit, sha256(substr(coalesce(b.n.o, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM src) s
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM s.conv_id AND b.i = 1
"""


OP12_SQL = _repair_sql()


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more of them share: how many went, and a digest of what is left."""
    found = line_dedup.deduplicated(read_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), "n_lines", F.size("places").cast("bigint").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


OP13_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line,
         translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
  CROSS JOIN UNNEST(range(1, len(l) + 1)) AS t(i)),
hot AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR last = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN hot USING (k) GROUP BY doc_id
"""

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_private_terms": op2_private_terms,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_licenses": op4_licenses,
    "op5_near_copies": op5_near_copies,
    "op6_secrets": op6_secrets,
    "op7_token_files": op7_token_files,
    "op8_paragraphs": op8_paragraphs,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_centroids": op11_centroids,
    "op12_conversations": op12_conversations,
    "op13_line_dedup": op13_line_dedup,
}
ORACLES = {
    "op2_private_terms": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op5_near_copies": OP5_SQL,
    "op10_mixing": OP10_SQL,
    "op11_centroids": OP11_SQL,
    "op12_conversations": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
