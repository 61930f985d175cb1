"""Each operator with production parameters over its whole table: the queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rampart.llm import decontaminate, htmltext, idstore, langid, neardup, pieces, pii, quality, search, storage, substrings


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the operators themselves take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    storage.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3_pii that SQL can express."""
    return op3_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.BASE), "base_sha256")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"))


def op6_idstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, tokenizer = storage.new_path(spark, "ids"), tokenizer_path("byte_bpe_50k.json")
    idstore.write(table(spark, sf_dir, "documents"), folder, tokenizer, end_id=2)
    idstore.verify(spark, folder)
    return idstore.summary(spark, folder, tokenizer)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.report(table(spark, sf_dir, "pages"))


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii": op3_pii,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_neardup": op5_neardup,
    "op6_idstore": op6_idstore,
    "op7_quality": op7_quality,
    "op8_langid": op8_langid,
    "op9_html": op9_html,
    "op10_search": op10_search,
    "pii_base": pii_base,
}

_BASE_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: len(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0"),
    "card": (
        r"[0-9]([\x20-]?[0-9])+",
        "len(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(digits) + 1), lambda i: CASE WHEN (len(digits) - i) % 2 = 0 THEN digits[i]::INT ELSE 2 * digits[i]::INT - CASE WHEN digits[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "len(digits) BETWEEN 9 AND 15"),
}


def _base_sql() -> str:
    found = " UNION ALL ".join(f"SELECT doc_id, nth, {n} AS k, '{kind}' AS kind, regexp_extract_all(t, '{regex}') AS ms, string_split_regex(t, '{regex}') AS gs FROM doc" for n, (kind, (regex, _)) in enumerate(_BASE_KINDS.items()))
    valid = " ".join(f"WHEN '{kind}' THEN {test}" for kind, (_, test) in _BASE_KINDS.items())
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in _BASE_KINDS)
    return rf"""
        WITH doc AS (SELECT doc_id, row_number() OVER () AS nth, coalesce(text, '') AS t FROM documents),
        found AS ({found}),
        each AS (SELECT doc_id, nth, k, kind, unnest(range(1, len(ms) + 1)) AS i, ms, gs FROM found),
        span AS (
            SELECT nth, k, kind, ms[i] AS m, regexp_replace(ms[i], '[^0-9]', '', 'g') AS digits,
                   list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a
            FROM each
        ),
        good AS (SELECT * FROM span WHERE CASE kind {valid} END),
        summed AS (SELECT nth, {counts}, string_agg(kind || ':' || a::BIGINT || ':' || (a + length(m))::BIGINT, ',' ORDER BY k, a) AS spans FROM good GROUP BY nth)
        SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in _BASE_KINDS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM doc LEFT JOIN summed USING (nth)
    """


ORACLE_SQL: dict[str, str] = {
    "op1_substrings": r"""
        WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        passage AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM doc WHERE len(words) >= 50)),
        earliest AS (SELECT w, min(doc_id) AS own FROM passage GROUP BY w),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM passage JOIN earliest USING (w) WHERE doc_id > own),
        word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM doc),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM doc LEFT JOIN kept USING (doc_id)
    """,
    "op2_decontaminate": rf"""
        WITH input AS (
            SELECT 'doc' AS side, doc_id AS id, hash(text) AS txt, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
            UNION SELECT 'item', item_id, hash(text), text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
        ),
        whole AS (SELECT side, id, txt, regexp_replace(regexp_replace(text, '([0-9])[.,]([0-9])', '\1{decontaminate.JOINER}\2', 'g'), '([0-9])[.,]([0-9])', '\1{decontaminate.JOINER}\2', 'g') AS text FROM input),
        split AS (
            SELECT side, id, txt, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS words,
                   list_concat(CASE WHEN regexp_matches(text, '^[^\p{{L}}\p{{N}}]') THEN []::VARCHAR[] ELSE [''] END, regexp_extract_all(text, '[^\p{{L}}\p{{N}}]+')) AS gaps
            FROM whole
        ),
        part AS (SELECT side, id, txt, generate_subscripts(words, 1) AS i, unnest(words) AS w, unnest(gaps[1:len(words)]) AS gap FROM split),
        lead_ AS (SELECT *, i > 1 AND gap IN (' ', ', ', '; ', ': ') AND regexp_matches(w, '^\p{{Lu}}') AS named FROM part),
        chain AS (SELECT *, coalesce(gap = ' ' AND regexp_matches(w, '^\p{{Lu}}') AND lag(named) OVER doc, false) AS goes_on FROM lead_ WINDOW doc AS (PARTITION BY side, id, txt ORDER BY i)),
        numbered AS (SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY side, id, txt ORDER BY i)::BIGINT AS t FROM chain),
        word AS (SELECT side, id, txt, t AS i, string_agg(w, '{decontaminate.JOINER}' ORDER BY i) AS w, arg_min(gap, i) AS gap, arg_min(named, i) AS named FROM numbered GROUP BY side, id, txt, t),
        typed AS (
            SELECT *, lower(w) AS value,
                   CASE WHEN regexp_matches(w, '^[0-9]') THEN '{decontaminate.NUMBER}'
                        WHEN len(gap) <= 2 AND regexp_matches(lag(w) OVER doc, '^[0-9]') AND lower(w) IN ({", ".join(f"'{u}'" for u in decontaminate.UNITS)}) THEN '{decontaminate.UNIT}'
                        WHEN named THEN '{decontaminate.NAME}'
                        ELSE lower(w) END AS c
            FROM word WINDOW doc AS (PARTITION BY side, id, txt ORDER BY i)
        ),
        slotted AS (SELECT *, c IN ('{decontaminate.NUMBER}', '{decontaminate.UNIT}', '{decontaminate.NAME}') AS slot FROM typed),
        win AS (
            SELECT side, id, txt, i, string_agg(c, ' ') OVER frame AS k, count(*) OVER frame AS n, sum(slot::INT) OVER frame AS slots
            FROM slotted WINDOW frame AS (PARTITION BY side, id, txt ORDER BY i ROWS BETWEEN CURRENT ROW AND {decontaminate.WINDOW - 1} FOLLOWING)
        ),
        size AS (SELECT id, txt, count(*) AS n FROM word WHERE side = 'item' GROUP BY id, txt),
        hit AS (
            SELECT DISTINCT d.id AS doc_id, d.txt, t.id AS item_id, t.txt AS item, d.i - t.i AS shift, t.i AS pos
            FROM win d JOIN win t ON d.k = t.k WHERE d.side = 'doc' AND t.side = 'item' AND d.n = {decontaminate.WINDOW} AND t.n = {decontaminate.WINDOW} AND t.slots <= {decontaminate.SLOTS}
        ),
        spot AS (SELECT DISTINCT doc_id, txt, item_id, item, shift, unnest(range(pos, pos + {decontaminate.WINDOW})) AS i FROM hit),
        cover AS (
            SELECT doc_id, spot.txt, item_id, item, shift, size.n, count(*) AS covered FROM spot JOIN size ON size.id = item_id AND size.txt = item
            GROUP BY ALL HAVING count(*) >= {decontaminate.SHARE} * size.n OR count(*) >= {decontaminate.ENOUGH}
        ),
        pair AS (
            SELECT spot.doc_id, spot.txt, spot.item_id, spot.item, spot.shift, count(DISTINCT (t.value, d.value)) AS pairs, count(DISTINCT t.value) AS own
            FROM spot JOIN slotted t ON t.side = 'item' AND t.id = item_id AND t.txt = item AND t.i = spot.i AND t.slot
            JOIN slotted d ON d.side = 'doc' AND d.id = doc_id AND d.txt = spot.txt AND d.i = spot.i + shift GROUP BY ALL
        ),
        ok AS (SELECT cover.* FROM cover LEFT JOIN pair USING (doc_id, txt, item_id, item, shift) WHERE pairs IS NULL OR pairs = own),
        over_ AS (
            SELECT id, txt FROM size WHERE n < {decontaminate.WINDOW}
            UNION SELECT id, txt FROM win WHERE side = 'item' AND n = {decontaminate.WINDOW} AND slots > {decontaminate.SLOTS}
        ),
        plain AS (SELECT side, id, txt, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS raw FROM input),
        wanted AS (SELECT id, txt, raw, least(len(raw), {decontaminate.WINDOW}) AS s FROM plain JOIN over_ USING (id, txt) WHERE side = 'item' AND len(raw) > 0),
        sizes AS (SELECT DISTINCT s FROM wanted),
        item_win AS (SELECT id, txt, len(raw) AS n, s, i, raw[i:i + s - 1] AS k FROM (SELECT *, unnest(range(1, len(raw) - s + 2)) AS i FROM wanted)),
        doc_win AS (SELECT id, txt, s, i, raw[i:i + s - 1] AS k FROM (SELECT id, txt, raw, s, unnest(range(1, len(raw) - s + 2)) AS i FROM plain, sizes WHERE side = 'doc' AND len(raw) >= s)),
        exact_spot AS (
            SELECT DISTINCT d.id AS doc_id, d.txt, t.id AS item_id, t.txt AS item, t.n, d.i - t.i AS shift, unnest(range(t.i, t.i + t.s)) AS i
            FROM doc_win d JOIN item_win t ON d.s = t.s AND d.k = t.k
        ),
        exact AS (
            SELECT doc_id, txt, item_id, item, shift, n, count(*) AS covered FROM exact_spot
            GROUP BY ALL HAVING count(*) >= {decontaminate.SHARE} * n OR count(*) >= {decontaminate.ENOUGH}
        ),
        best AS (SELECT doc_id, item_id, max(row(covered, n)) AS b FROM (SELECT doc_id, item_id, covered, n FROM ok UNION ALL SELECT doc_id, item_id, covered, n FROM exact) GROUP BY ALL)
        SELECT doc_id, item_id, b[1]::BIGINT AS covered, b[2]::BIGINT AS n_tokens FROM best
    """,
    "pii_base": _base_sql(),
    "op10_search": rf"""
        WITH word AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')) AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        tf AS (SELECT doc_id, w, count(*) AS tf FROM word GROUP BY ALL),
        len AS (SELECT doc_id, count(*) AS n FROM word GROUP BY ALL),
        stats AS (SELECT (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) AS docs, (SELECT sum(n) FROM len) AS words),
        idf AS (SELECT w, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY w, docs),
        gain AS (SELECT doc_id, w, idf * tf * {search.K1 + 1} / (tf + {search.K1} * ({1 - search.B} + {search.B} * n / (words / docs))) AS gain FROM tf JOIN len USING (doc_id) JOIN idf USING (w), stats),
        score AS (SELECT q.doc_id AS query_id, gain.doc_id, round(sum(q.tf * gain), {search.DECIMALS}) AS score FROM tf q JOIN gain USING (w) WHERE q.doc_id % 100 = 0 GROUP BY ALL),
        ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM score)
        SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= {search.TOP}
    """,
}
