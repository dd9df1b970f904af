"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.llm import bpe, chat, decontam, exact_dedup, lm, quality, repair, runs, simhash, substring, topk, url_filter, warc
from inspectra.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = f'{{"conv_id": -1, "messages": [{{"role": "user", "content": "{said}"}}, {{"role": "assistant", "content": "{said}"}}]}}'
    turns = chat.table_turns(table(spark, sf_dir, "conversations")).unionByName(chat.canonical_turns(spark.createDataFrame([(own,)], "record string")))
    return chat.digest_conversations(chat.read_segments(chat.format_turns(turns)))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"))).drop("url")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents")).drop("n_points", "digest")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), word_bpe_path()))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.deduplicate(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents")).select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    model = lm.train(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return lm.score(docs, model, laid=model.laid)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Of one document in ten (by the CRC of its id) the words from one on repeat
    those that follow it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), "")
    n, a, p = F.size("_words"), F.col("_a"), F.col("_p")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("_words"))
    rows = rows.withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("_words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.concat(F.slice("_words", F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return rows.select("doc_id", F.when(a.isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, longest).alias("best"), lines.alias("lines"), "collapsed_text")
    return found.select(
        "doc_id", "n_runs", F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_damage(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user, by a CRC."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    return turns.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = repair.repair(with_damage(turns)).conversations().withColumnRenamed("conv_id", "_found")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    all_ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def _crc32(text: str) -> str:
    """SQL of the CRC of an ASCII text: of each byte an exclusive or, then eight shifts."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda k: list_prepend(CAST(ascii(substr({text}, CAST(k AS INTEGER), 1)) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END))"


def _repair_step() -> str:
    """SQL of one step of the search: b holds the best of the states nothing, s, u,
    a as nine digits of cost and the audit, so that the least text is the best; x is
    the row's initial and fault, or the place for an insert."""

    def then(state: int, cost: str, edit: str) -> str:
        return f"lpad(CAST(CAST(substr(b[{state}], 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr(b[{state}], 10) || '{edit}'"

    def row(to: int, initial: str, *before: int) -> str:
        ways = [f"CASE WHEN x[1] = '{initial}' AND x[2] IN ('0', '3') THEN {then(s, more, 'K')} END" for s in before]
        ways += [f"CASE WHEN x[2] IN ('0', '3') THEN {then(s, '1 + ' + more, 'R')} END" for s in before if initial != "s"]
        return f"least({', '.join([then(to, '2', 'D'), *ways])})"

    more = "(CASE x[2] WHEN '3' THEN 5 ELSE 0 END)"
    return f"""CASE x[1]
        WHEN '+u' THEN [b[1], b[2], least(b[3], {then(1, '5', 'I')}, {then(2, '5', 'I')}, {then(4, '5', 'I')}), b[4]]
        WHEN '+a' THEN [b[1], b[2], b[3], least(b[4], {then(3, '5', 'I')})]
        ELSE [{then(1, '2', 'D')}, {row(2, 's', 1)}, {row(3, 'u', 1, 2, 4)}, {row(4, 'a', 3)}] END"""


_ESCAPES = "".join(f" + (length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in ["\\", *chat.CONTROLS])

SQL = {
    "op1_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        s AS (
            SELECT *, (SELECT length(x){_ESCAPES} FROM (SELECT text AS x)) AS n_text, (SELECT length(x){_ESCAPES} FROM (SELECT role AS x)) AS n_role FROM t)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
            CAST(sum(n_text + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 19 ELSE n_role + 19 END) AS BIGINT) AS formatted_chars
        FROM s GROUP BY conv_id""",
    "op2_warc_archive": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, upper(sha1(payload)) AS hex FROM p),
        b AS (
            SELECT *, list_reduce(list_prepend('', list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                list_sum(list_transform(range(0, 5), lambda k: (((strpos('0123456789ABCDEF', substr(hex, 1 + (5 * i + k) // 4, 1)) - 1) >> (3 - (5 * i + k) % 4)) & 1) << (4 - k))) AS BIGINT), 1))), lambda a, c: a || c) AS payload_digest,
                max(page_id) OVER (PARTITION BY hex) AS best
            FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> best THEN best END AS refers_to
        FROM b""",
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
        SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
            row_number() OVER g = 1 AS kept, h AS text_sha256
        FROM d WINDOW g AS (PARTITION BY h ORDER BY n DESC, doc_id)""",
    "op11_runs": rf"""
        WITH c AS (SELECT doc_id, {_crc32("CAST(doc_id AS VARCHAR)")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM c),
        a AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM g),
        p AS (SELECT *, CASE WHEN planted THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
        d AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM p),
        t AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
        m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
        e AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM e GROUP BY doc_id, start, length),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
        kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY t.doc_id),
        per AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
                first({{'s': start, 'l': length, 'p': period}} ORDER BY length DESC, start, period) AS best
            FROM r GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
            sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_repair": rf"""
        WITH k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k
            FROM conversations),
        d AS (
            SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM k WHERE k <> 0),
        n AS (SELECT *, substr(role, 1, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
        f AS (
            SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair,
                CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault
            FROM n),
        g AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
                flatten(list([[c, CAST(fault AS VARCHAR)], ['+u', ''], ['+a', '']] ORDER BY i)) AS steps
            FROM f GROUP BY conv_id),
        b AS (
            SELECT * EXCLUDE steps, list_reduce(list_concat([['000000000', NULL, NULL, NULL], ['+u', ''], ['+a', '']], steps), lambda b, x: {_repair_step()}) AS b FROM g),
        a AS (SELECT * EXCLUDE b, CAST(substr(least(b[1], b[4]), 1, 9) AS BIGINT) AS cost, substr(least(b[1], b[4]), 10) AS audit FROM b),
        e AS (
            SELECT conv_id, audit, j, substr(audit, CAST(j AS INTEGER), 1) AS edit, length(replace(substr(audit, 1, CAST(j AS INTEGER)), 'I', '')) AS i,
                length(replace(substr(audit, 1, CAST(j AS INTEGER)), 'D', '')) AS place, length(replace(audit, 'D', '')) AS m
            FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM a)),
        r AS (
            SELECT e.conv_id, string_agg(CASE edit WHEN 'K' THEN n.role WHEN 'D' THEN '' ELSE CASE (place + m) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END
                || ':' || CASE edit WHEN 'I' THEN '' ELSE n.text END, chr(10) ORDER BY j) AS repaired
            FROM e LEFT JOIN n ON e.conv_id IS NOT DISTINCT FROM n.conv_id AND e.i = n.i AND edit <> 'I' WHERE edit <> 'D' GROUP BY e.conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN a ON o.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON o.conv_id IS NOT DISTINCT FROM r.conv_id""",
    "op13_topk": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(row_number() OVER g AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW g AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER g <= 10""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_warc_archive, op3_url_filter, op4_exact_dedup, op5_quality, op6_decontamination, op7_bpe, op8_substring_dedup, op9_simhash, op10_lm_score, op11_runs, op12_repair, op13_topk)
}
