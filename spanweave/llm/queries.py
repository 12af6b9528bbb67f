"""The registered queries: each operator over its whole table, with production parameters, reduced to its digest columns."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, hamerly, itq, media, mincut, mixing, quality_rules, repair, sentencepieces, simhash, substring, warc
from .shared import stage, table

#: Folder of public vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def _vocabulary(name: str) -> str:
    return f"{TOKENIZERS}/{name}"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vocabulary("byte_bpe_50k.tiktoken")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.assemble(rows.unionByName(extra), path), path)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.encode(docs, _vocabulary("piece_bpe_32k.model")).drop("text")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents")).withColumn("n_clips", F.size("clips").cast("long")).drop("clips")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), stage)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), stage=stage).select("doc_id", "size", "source_size", "target", "taken")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents")).drop("n_spans")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = classifier.train(docs, table(spark, sf_dir, "labels"))
    out = classifier.score(docs, weights)
    return out.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stage(warc.write_archives(table(spark, sf_dir, "pages")), "warc")
    records = warc.read_archives(archives).where(F.col("problem").isNull())
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.extract(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.digest(repair.repair(repair.damage(rows)), rows.select("conv_id"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.digest(table(spark, sf_dir, "embeddings")).drop("scans")


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_sentencepiece, op3_media, op4_quality_rules, op5_mixing,
        op6_substring_dedup, op7_simhash, op8_quality_classifier, op9_warc, op10_main_text,
        op11_conversation_repair, op12_centroid_clustering, op13_embedding_dedup,
    )
}

#: SQL for the operators that it can express.  The marks' lengths are those of the template (4, 2 and 9 characters).
_ESCAPES = r"len(regexp_extract_all({0}, '\\|###|</turn>{1}'))"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_NIBBLES = "".join(f"{i:04b}" for i in range(16))


def hamerly_sql(clusters: int = 40, rounds: int = 5) -> str:
    """Plain rounds, all distances in full."""
    steps = [
        """d AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "n AS MATERIALIZED (SELECT row_number() OVER () AS row, * FROM d)",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS m FROM n WHERE vec_id IS NOT NULL QUALIFY c < {clusters})""",
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT row, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), c := c)) AS best FROM n, c{k} GROUP BY row)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT best.c AS c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM n JOIN a{k} USING (row)),
      g{k} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS t, count(*) AS k FROM s{k} GROUP BY ALL),
      u{k} AS (SELECT c, list((t - (t % k + k) % k) // k ORDER BY i) AS m FROM g{k} GROUP BY c),
      c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(u{k}.m, o.m) AS m FROM c{k} o LEFT JOIN u{k} USING (c))""")
    return "WITH " + ",\n      ".join(steps) + f"""
      SELECT vec_id, CAST(best.c AS INT) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(m, ',')) AS centroid_sha256 FROM n JOIN a{rounds} USING (row) JOIN c{rounds} ON c = best.c"""


def repair_sql() -> str:
    """Damage, faults, and a fold over each conversation's rows that keeps the cheapest (cost, audit) of each of the four states."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    crc = "list_reduce(flatten(list_transform(range(1, length(key) + 1), lambda i: [CAST(ascii(substr(key, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, CAST(4294967295 AS BIGINT))"
    none = "{'c': CAST(1000000000 AS BIGINT), 'a': ''}"
    plus = lambda s, c, edit: f"{{'c': {s}.c + {c}, 'a': {s}.a || '{edit}'}}"
    least = lambda *s: f"list_min([{', '.join(s)}])"
    start, system, user, assistant = (f"acc.s[{k}]" for k in (1, 2, 3, 4))
    keep = lambda s, k: f"CASE WHEN x.k = {k} THEN {plus(s, 'x.more', 'K')} ELSE {none} END"
    rerole = lambda s: f"CASE WHEN x.gone THEN {none} ELSE {plus(s, '1 + x.more', 'R')} END"
    drop = lambda s: plus(s, 2, "D")
    after = ", ".join((
        drop(start), least(drop(system), keep(start, 1)), least(drop(user), *(f(s) for s in (start, system, assistant) for f in (lambda s: keep(s, 2), rerole))), least(drop(assistant), keep(user, 3), rerole(user)),
    ))
    inserted = f"list_transform([[{after}]], lambda t: list_transform([{least('t[3]', *(plus(f't[{k}]', 5, 'I') for k in (1, 2, 4)))}], lambda u: [t[1], t[2], u, {least('t[4]', plus('u', 5, 'I'))}])[1])[1]"
    state = "STRUCT(c BIGINT, a VARCHAR)[]"
    begin = f"{{'k': 0, 'gone': false, 'more': CAST(0 AS BIGINT), 's': CAST([{{'c': 0, 'a': ''}}, {{'c': 1000000000, 'a': ''}}, {{'c': 5, 'a': 'I'}}, {{'c': 10, 'a': 'II'}}] AS {state})}}"
    return rf"""WITH h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
      c AS (SELECT *, xor({crc}, 4294967295) % 20 AS hit FROM h),
      d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE hit <> 0),
      o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, right(rtrim(text, {space}), 1) AS tip FROM d),
      f AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN tip = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN tip NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS flaw FROM o),
      g AS (SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE CAST(least(CAST(max(turn) AS HUGEINT) - min(turn) + 1 - count(DISTINCT turn), 9223372036854775807) AS BIGINT) END AS gaps, count(*) FILTER (flaw = 'blank') AS blank, count(*) FILTER (flaw = 'duplicate') AS duplicate, count(*) FILTER (flaw = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal,
        list({{'k': CASE WHEN flaw IN ('blank', 'duplicate') THEN 0 WHEN ini = 's' THEN 1 WHEN ini = 'u' THEN 2 WHEN ini = 'a' THEN 3 ELSE 0 END, 'gone': flaw IN ('blank', 'duplicate'), 'more': CAST(CASE WHEN flaw = 'truncated' THEN 5 ELSE 0 END AS BIGINT), 's': CAST(NULL AS {state})}} ORDER BY i) AS xs FROM f GROUP BY conv_id),
      r AS (SELECT *, list_reduce(xs, lambda acc, x: {{'k': 0, 'gone': false, 'more': CAST(0 AS BIGINT), 's': {inserted}}}, {begin}).s AS s FROM g),
      b AS (SELECT * EXCLUDE (xs, s), {least('s[1]', 's[4]')} AS best FROM r),
      e AS (SELECT conv_id, p, substr(best.a, p, 1) AS edit FROM (SELECT conv_id, best, unnest(range(1, length(best.a) + 1)) AS p FROM b)),
      n AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS place FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
      t AS (SELECT n.*, f.role, f.text, f.ini, bool_or(place = 1 AND edit = 'K' AND f.ini = 's') OVER (PARTITION BY n.conv_id) AS led FROM n LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.i = n.i AND n.edit <> 'I'),
      z AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS sha FROM t WHERE edit <> 'D' GROUP BY conv_id)
      SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
      FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM k.conv_id"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE: dict[str, str] = {
    "op1_chat_formatting": rf"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, tie)) AS turns_sha256,
        CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, tie), '')) AS loss_sha256,
        CAST(sum(15 + length(role) + {_ESCAPES.format('role', '|:')} + length(text) + {_ESCAPES.format('text', '')}) AS BIGINT) AS formatted_chars FROM (SELECT *, md5(role || chr(10) || text) AS tie FROM r) GROUP BY conv_id""",
    "op5_mixing": f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5(concat_ws('|', '42', coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))), source)), 1, 8) AS BIGINT) >> 2 AS draw FROM documents),
      p AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, [5.0, 2.0, 1.0][1 + CAST((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS INT)]::DOUBLE AS w FROM d GROUP BY source),
      o AS (SELECT *, 2.0::DOUBLE * ss AS room, 1.5::DOUBLE * sum(ss) OVER () AS total, sum(w) OVER () AS ws FROM p),
      l AS (SELECT *, row_number() OVER r AS place, (total - coalesce(sum(room) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (ws - coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
        FROM o WINDOW r AS (ORDER BY room / w, source NULLS LAST)),
      t AS (SELECT source, ss, CASE WHEN water IS NULL THEN room ELSE least(room, w * water) END AS target FROM (SELECT *, (SELECT arg_min(level, place) FROM l WHERE room / w > level) AS water FROM l)),
      b AS (SELECT *, CASE WHEN ss > 0 THEN CAST(floor(target / ss) AS BIGINT) ELSE 0 END AS whole, CASE WHEN ss > 0 THEN target - floor(target / ss) * ss ELSE 0 END AS rest FROM t),
      c AS (SELECT source, draw, sum(words) OVER (PARTITION BY source ORDER BY draw) - words AS before, words FROM (SELECT source, draw, sum(size) AS words FROM d GROUP BY 1, 2)),
      m AS (SELECT c.source, min(draw + CASE WHEN 2 * (rest - before) >= words THEN 1 ELSE 0 END) AS bar FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source WHERE before <= rest AND rest < before + words GROUP BY 1)
      SELECT d.doc_id, d.size, b.ss AS source_size, b.target, (b.whole + CASE WHEN d.draw < m.bar THEN 1 ELSE 0 END) * d.size AS taken FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source""",
    "op6_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
      g AS (SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS k, w FROM d WHERE len(w) >= 13),
      s AS (SELECT doc_id, k, array_to_string(list_slice(w, k, k + 12), ' ') AS win FROM g),
      f AS (SELECT win, min(doc_id) AS first FROM s GROUP BY 1),
      c AS (SELECT DISTINCT s.doc_id, unnest(generate_series(k, k + 12)) AS p FROM s JOIN f USING (win) WHERE f.first < s.doc_id),
      q AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM d WHERE len(w) > 0),
      t AS (SELECT q.doc_id, count(c.p) AS n_removed, coalesce(string_agg(CASE WHEN c.p IS NULL THEN word END, ' ' ORDER BY q.p), '') AS kept FROM q LEFT JOIN c ON q.doc_id = c.doc_id AND q.p = c.p GROUP BY 1)
      SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
    "op11_conversation_repair": repair_sql(),
    "op12_centroid_clustering": hamerly_sql(),
    "op9_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
      b AS (SELECT *, array_to_string([substr('{_NIBBLES}', 4 * strpos('0123456789abcdef', substr(x, i, 1)) - 3, 4) for i in range(1, 41)], '') AS bits FROM s)
      SELECT page_id, payload_bytes, array_to_string([substr('{_BASE32}', 1 + 16 * CAST(substr(bits, 5 * j + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * j + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * j + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * j + 4, 1) AS INT) + CAST(substr(bits, 5 * j + 5, 1) AS INT), 1) for j in range(0, 32)], '') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b""",
}
