"""Queries of the screening operators over whole tables, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.functions import fuzzy, match, spec, text
from rampart.operators import relational as R
from rampart.plans import pipeline as P
from rampart.plans import sql
from rampart.sources import PAYLOADS, attacks, planted, table

Query = Callable[[SparkSession, str], DataFrame]


def _norm(df: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    return df.select(*keys, text.normalize_text(F.col(text_col)).alias("norm"))


def _rows(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c not in ("ord", "position")), F.col("position").cast("bigint").alias("position"))


def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _norm(table(spark, sf_dir, "documents"), "doc_id")


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


def prefilter_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _norm(attacks(spark, sf_dir), "doc_id").select("doc_id", match.has_signal(F.col("norm")).alias("signal"))


def detect_regex_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(R.regex_rows(attacks(spark, sf_dir), ["doc_id"]))


def detections_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_regex_all(spark, sf_dir).groupBy("pattern_name", "risk_level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def detect_fr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_regex_all(spark, sf_dir).where(F.startswith("pattern_name", F.lit("fr_")))


def deleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _norm(attacks(spark, sf_dir), "doc_id").select("doc_id", "norm", text.deleet_text(F.col("norm")).alias("read"))
    return n.where("read != norm").select("doc_id", "read")


def detect_leet(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _norm(attacks(spark, sf_dir), "doc_id").withColumn("read", text.deleet_text(F.col("norm")))
    found = n.select("doc_id", F.explode(match.leet_detections(F.col("norm"), F.col("read"))).alias("d")).select("doc_id", "d.*")
    return _rows(found)


def leet_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(R.leet_rows(attacks(spark, sf_dir), ["doc_id"]))


def _fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _norm(attacks(spark, sf_dir), "doc_id")
    return _rows(n.select("doc_id", F.explode(fuzzy.fuzzy_detections(F.col("norm"))).alias("d")).select("doc_id", "d.*"))


def typo_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fuzzy(spark, sf_dir).where(F.startswith("pattern_name", F.lit("typoglycemia:")))


def typo_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fuzzy(spark, sf_dir).where(F.startswith("pattern_name", F.lit("typoglycemia_phrase:")))


def typo_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(R.fuzzy_rows(attacks(spark, sf_dir), ["doc_id"]))


def typo_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens scanned in each text and the last one's position: the head and tail cap."""
    t = R.token_table(attacks(spark, sf_dir), ["doc_id"])
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.max("position").cast("bigint").alias("last"))


def escape_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attacks(spark, sf_dir).select("doc_id", text.escape_data_tags(F.col("text")).alias("escaped"))


def wrap_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat("source", F.lit(" <\"'&>"))
    return attacks(spark, sf_dir).select("doc_id", text.wrap_in_data_tags(F.col("text"), source).alias("wrapped"))


def strip_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over texts that are marked as a whole, one in three with a second mark inside."""
    inner = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[SANITIZED: x:y]a\nb[/SANITIZED] "), "text")).otherwise(F.col("text"))
    marked = F.concat(F.lit("go [SANITIZED: name]"), inner, F.lit("[/SANITIZED] end"))
    return attacks(spark, sf_dir).select("doc_id", text.strip_sanitization_markers(marked).alias("stripped"))


def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scores(R.regex_rows(attacks(spark, sf_dir), ["doc_id"]), ["doc_id"]).select("doc_id", F.round("risk_score", 2).alias("risk_score"))


def _sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sanitize(attacks(spark, sf_dir), "text", "source").select("doc_id", "result.*")


def sanitize_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _sanitized(spark, sf_dir)
    names = F.array_join(F.transform("detected_patterns", lambda d: F.concat_ws("@", d["pattern_name"], d["position"])), ",")
    return r.select("doc_id", "sanitized_text", names.alias("detected"), F.round("risk_score", 2).alias("risk_score"), "content_hash", "was_modified", "source")


def risk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score over all three layers with their length gates, and whether the text is marked."""
    r = _sanitized(spark, sf_dir)
    marked = F.col("risk_score") >= spec.MODIFICATION_THRESHOLD
    return r.select("doc_id", F.size("detected_patterns").cast("bigint").alias("n"), F.round("risk_score", 2).alias("risk_score"), marked.alias("marked"), "was_modified")


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = P.audit(attacks(spark, sf_dir), "text", "source")
    return a.select("source", "content_hash", "detection_layer", F.array_join("patterns_detected", ",").alias("patterns"), F.round("risk_score", 2).alias("risk_score"), "action_taken")


def source_risk_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.source_rollup(attacks(spark, sf_dir))
    return r.select("source", "texts", "detected", "modified", F.round("highest", 2).alias("highest"))


def conversation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, one in three with an attack."""
    turns = planted(table(spark, sf_dir, "conversations"), F.col("conv_id") + F.col("turn"), "text", 3)
    return _rows(R.regex_rows(turns, ["conv_id", "turn"]))


def pages_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages, one in two with an attack behind its end."""
    return _rows(R.regex_rows(planted(table(spark, sf_dir, "pages"), F.col("page_id"), "html", 2), ["page_id"], "html", use_prefilter=False))


#: Texts that normalization changes, and what it makes of them.
UNICODE = (
    ("ﬁne Ｄａｔａ ① ½", "fine data 1 1⁄2"), ("Ig\u200bno\u200dre\ufeff so\u00adft\u2060", "ignore soft"), ("Straße ẞ ſ K", "strasse ss s k"), ("İstanbul", "i\u0307stanbul"), ("Cafe\u0301 ÉTÉ", "café été"),
    ("Іgnоrе аll", "іgnore all"), ("Ѕуѕtеm рrοmрt", "ѕystem prompt"), ("ǃ ɡo ΑΒ", "! go αβ"), ("e\u0323\u0307 ﷺ".split(" ")[0], "ẹ\u0307"), ("㎏ ℡ Ⅷ", "kg tel viii"),
)


def normalize_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with such a text before theirs."""
    lead = F.element_at(F.array(*(F.lit(raw) for raw, _ in UNICODE)), (F.col("doc_id") % len(UNICODE) + 1).cast("int"))
    return _norm(table(spark, sf_dir, "documents").select("doc_id", F.concat(lead, F.lit(" "), "text").alias("text")), "doc_id")


def homoglyph_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latin letters replaced by look-alikes fold back: every row must be true."""
    latin, alike = "aeocpx", "аеосрх"
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.translate("text", latin, alike).alias("disguised"))
    return d.select("doc_id", text.normalize_text(F.col("text")).alias("a"), text.normalize_text(F.col("disguised")).alias("b")).select("doc_id", (F.col("a") == F.col("b")).alias("folds"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screening by the session's SQL functions alone."""
    sql.register(spark)
    attacks(spark, sf_dir).createOrReplaceTempView("rampart_attacks")
    return spark.sql(
        """SELECT doc_id, size(detect_injection_patterns(text)) AS regex, size(detect_leet_injection(text)) AS leet, size(detect_typoglycemia(text)) AS fuzzy,
        round(calculate_risk_score(detect_injection_patterns(text)), 2) AS risk_score, sanitize(text, source).sanitized_text AS sanitized_text FROM rampart_attacks"""
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        normalize_documents, content_hash, prefilter_gate, detect_regex_all, detections_by_pattern, detect_fr, deleet, detect_leet, leet_anti_join,
        typo_keywords, typo_phrases, typo_relational, typo_tokens, escape_tags, wrap_tags, strip_markers, risk_score, risk_threshold, sanitize_full,
        audit_events, source_risk_rollup, conversation_scan, pages_scan, homoglyph_fold, normalize_unicode, sql_functions,
    )
}


# --- SQL -------------------------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ATTACKS = (
    "attack AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN ltrim(p) ELSE text || p END AS text FROM (SELECT *, CASE doc_id % "
    + str(len(PAYLOADS))
    + "".join(f" WHEN {i} THEN {_q(p)}" for i, p in enumerate(PAYLOADS))
    + " END AS p FROM documents))"
)
#: Composed Latin text: lower case with one full fold is all that normalization does.
_FOLD = "replace(lower({}), 'ß', 'ss')"


def _planted(name: str, key: str, column: str, every: int) -> str:
    return f"{name}_planted AS (SELECT * REPLACE (CASE WHEN ({key}) % {every} = 0 THEN {column} || CASE ({key}) % {len(PAYLOADS)}" + "".join(f" WHEN {i} THEN {_q(p)}" for i, p in enumerate(PAYLOADS)) + f" END ELSE {column} END AS {column}) FROM {name})"


def _base(source: str = "attack", keys: str = "doc_id", text_col: str = "text", first: str = _ATTACKS) -> str:
    return f"{first}, n AS (SELECT {keys}, {text_col} AS raw, {_FOLD.format(text_col)} AS n FROM {source})"


_SIGNAL = "(" + " OR ".join(f"contains(n, {_q(w)})" for w in spec.SIGNAL_WORDS) + ")"


def _scan(name: str, source: str, column: str, keys: str = "doc_id", where: str = "true", prefix: str = "", promote: bool = False) -> str:
    """CTEs with every match of the bank in a column: keys, pattern_name, matched_text, position, risk_level."""
    each = " UNION ALL ".join(
        f"SELECT {keys}, {k} AS ord, {_q(prefix + p.name)} AS pattern_name, {_q(spec.RISK_PROMOTED[p.risk] if promote else p.risk)} AS risk_level, "
        f"regexp_extract_all({column}, {_q('(?i)' + p.regex)}) AS ms, string_split_regex({column}, {_q('(?i)' + p.regex)}) AS gs FROM {source} WHERE {where} AND regexp_matches({column}, {_q('(?i)' + p.regex)})"
        for k, p in enumerate(spec.PATTERNS)
    )
    return (
        f"{name}_m AS ({each}), {name}_i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM {name}_m), "
        f"{name} AS (SELECT {keys}, ord, pattern_name, ms[i] AS matched_text, risk_level, "
        f"(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS position FROM {name}_i)"
    )


_LEET_FROM, _LEET_TO = "".join(spec.LEET), "".join(spec.LEET.values())
_MIXED = f"regexp_matches(t, '[a-zA-Z]') AND regexp_matches(t, {_q(spec.LEET_CLASS)})"
_READ = rf"""r AS (SELECT *, array_to_string(list_transform(regexp_extract_all(n, '\s+|\S+'), lambda t: CASE WHEN {_MIXED} THEN translate(t, {_q(_LEET_FROM)}, {_q(_LEET_TO)}) ELSE t END), '') AS read FROM n)"""
_LEET = f"{_READ}, {_scan('deep', 'r', 'read', where='read <> n', prefix='leet:', promote=True)}, {_scan('flat', 'r', 'n', where='read <> n', prefix='leet:')}, leet AS (SELECT deep.* FROM deep ANTI JOIN flat USING (doc_id, pattern_name, position))"
_KEYWORDS = "(VALUES " + ", ".join(f"({_q(k)}, {fuzzy.most_edits(k)})" for k in spec.KEYWORDS) + ") k(keyword, most)"
_TOKENS = rf"""w AS (SELECT doc_id, list_filter(string_split_regex(n, '\s+'), lambda x: x <> '') AS words FROM n),
    u AS (SELECT doc_id, len(words) AS size, unnest(words) AS word, generate_subscripts(words, 1) AS idx FROM w),
    placed AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM u),
    token AS (SELECT doc_id, idx, position, trim(word, {_q(spec.EDGE_PUNCTUATION)}) AS token FROM placed WHERE size <= {2 * spec.SCANNED_TOKENS} OR idx <= {spec.SCANNED_TOKENS} OR idx > size - {spec.SCANNED_TOKENS})"""
_FUZZY = f"""{_TOKENS},
    mark AS (
        SELECT token.*, keyword FROM token LEFT JOIN {_KEYWORDS} ON length(token) BETWEEN 4 AND 15 AND token[1] = keyword[1] AND token[-1] = keyword[-1]
            AND list_sum(list_transform(list_distinct(string_split(token || keyword, '')), lambda c: abs(length(token) - length(replace(token, c, '')) - length(keyword) + length(replace(keyword, c, ''))))) <= 1
            AND damerau_levenshtein(token, keyword) <= most
    ),
    wide AS (SELECT *, lead(keyword) OVER s AS k1, lead(keyword, 2) OVER s AS k2, lead(token) OVER s AS t1, lead(token, 2) OVER s AS t2 FROM mark WINDOW s AS (PARTITION BY doc_id ORDER BY idx)),
    single AS (SELECT doc_id, -1 AS ord, 'typoglycemia:' || keyword AS pattern_name, token AS matched_text, position, 'high' AS risk_level FROM mark WHERE keyword <> token),
    phrase AS ({" UNION ALL ".join(
        f"SELECT doc_id, {k} AS ord, {_q('typoglycemia_phrase:' + '_'.join(p))} AS pattern_name, concat_ws(' ', {', '.join(('token', 't1', 't2')[:len(p)])}) AS matched_text, position, 'high' AS risk_level FROM wide WHERE "
        + ' AND '.join(f'{c} = {_q(x)}' for c, x in zip(('keyword', 'k1', 'k2'), p, strict=False))
        for k, p in enumerate(spec.PHRASES)
    )})"""
_COLUMNS = "doc_id, pattern_name, matched_text, position, risk_level"
_REGEX = _scan("found", "n", "n", where=_SIGNAL)
_WEIGHT = "CASE risk_level " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in spec.RISK_WEIGHTS.items()) + f" ELSE {spec.UNKNOWN_WEIGHT} END"
_EVADES = r"len(list_filter(string_split_regex(raw, '\s+'), lambda t: " + _MIXED + ")) > 0"
_ESCAPED = f"regexp_replace(regexp_replace({{}}, '(?i)</data-content>', {_q(spec.DATA_TAG_CLOSE_ESCAPED)}, 'g'), '(?i)<data-content\\b', {_q(spec.DATA_TAG_OPEN_ESCAPED)}, 'g')"
_LAYERS = _COLUMNS + ", ord"
_ALL = f"""{_base()}, {_REGEX}, {_LEET}, {_FUZZY},
    gated AS (
        SELECT {_LAYERS}, 0 AS layer FROM found
        UNION ALL SELECT {', '.join('leet.' + c for c in _LAYERS.split(', '))}, 1 FROM leet JOIN n USING (doc_id) WHERE length(raw) >= {spec.LEET_MIN_LENGTH} OR {_EVADES}
        UNION ALL SELECT {', '.join('f.' + c for c in _LAYERS.split(', '))}, 2 FROM (FROM single UNION ALL FROM phrase) f JOIN n USING (doc_id) WHERE length(raw) >= {spec.FUZZY_MIN_LENGTH}
    ),
    score AS (
        SELECT doc_id, count(*) AS c, string_agg(pattern_name, ',' ORDER BY layer, position, ord) AS patterns, string_agg(pattern_name || '@' || position, ',' ORDER BY layer, position, ord) AS detected,
               least(sum({_WEIGHT}) / 100.0, 1.0)::DOUBLE AS s FROM gated GROUP BY doc_id
    ),
    judged AS (
        SELECT doc_id, raw, n, coalesce(c, 0)::BIGINT AS c, coalesce(patterns, '') AS patterns, coalesce(detected, '') AS detected, coalesce(s, 0.0) AS s, coalesce(s, 0.0) >= {spec.MODIFICATION_THRESHOLD} AS marked,
               coalesce(s, 0.0) >= {spec.MODIFICATION_THRESHOLD} OR {_ESCAPED.format('raw')} <> raw AS was_modified
        FROM n LEFT JOIN score USING (doc_id)
    )"""
#: Marks go in from the last position to the first, each into the text as it is by then.
_MARKED = f"""WITH RECURSIVE {_ALL},
    step AS (SELECT gated.doc_id, pattern_name, length(matched_text) AS len, position AS pos, row_number() OVER (PARTITION BY gated.doc_id ORDER BY position DESC, layer, ord) AS k FROM gated JOIN judged USING (doc_id) WHERE marked),
    splice AS (
        SELECT doc_id, 0::BIGINT AS k, n AS t FROM judged WHERE marked
        UNION ALL
        SELECT splice.doc_id, step.k, substr(t, 1, pos) || '{spec.MARK_OPEN}' || pattern_name || ']' || substr(t, pos + 1, len) || '{spec.MARK_CLOSE}' || substr(t, pos + len + 1)
        FROM splice JOIN step ON step.doc_id = splice.doc_id AND step.k = splice.k + 1
    ),
    done AS (SELECT doc_id, arg_max(t, k) AS t FROM splice GROUP BY doc_id),
    cleaned AS (SELECT judged.*, coalesce({_ESCAPED.format('t')}, {_ESCAPED.format('raw')}) AS sanitized_text FROM judged LEFT JOIN done USING (doc_id))"""
_HTML = "replace(replace(replace(replace(replace(source || ' <\"''&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"

ORACLE_SQL: dict[str, str] = {
    "normalize_documents": f"SELECT doc_id, {_FOLD.format('text')} AS norm FROM documents",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "prefilter_gate": f"WITH {_base()} SELECT doc_id, {_SIGNAL} AS signal FROM n",
    "detect_regex_all": f"WITH {_base()}, {_REGEX} SELECT {_COLUMNS} FROM found",
    "detections_by_pattern": f"WITH {_base()}, {_REGEX} SELECT pattern_name, risk_level, count(*) AS n, count(DISTINCT doc_id) AS docs FROM found GROUP BY ALL",
    "detect_fr": f"WITH {_base()}, {_REGEX} SELECT {_COLUMNS} FROM found WHERE pattern_name LIKE 'fr\\_%' ESCAPE '\\'",
    "deleet": f"WITH {_base()}, {_READ} SELECT doc_id, read FROM r WHERE read <> n",
    "detect_leet": f"WITH {_base()}, {_LEET} SELECT {_COLUMNS} FROM leet",
    "leet_anti_join": f"WITH {_base()}, {_LEET} SELECT {_COLUMNS} FROM leet",
    "typo_keywords": f"WITH {_base()}, {_FUZZY} SELECT {_COLUMNS} FROM single",
    "typo_phrases": f"WITH {_base()}, {_FUZZY} SELECT {_COLUMNS} FROM phrase",
    "typo_relational": f"WITH {_base()}, {_FUZZY} SELECT {_COLUMNS} FROM single UNION ALL SELECT {_COLUMNS} FROM phrase",
    "typo_tokens": f"WITH {_base()}, {_TOKENS} SELECT doc_id, count(*) AS tokens, max(position)::BIGINT AS last FROM token GROUP BY doc_id",
    "escape_tags": f"WITH {_ATTACKS} SELECT doc_id, {_ESCAPED.format('text')} AS escaped FROM attack",
    "wrap_tags": f"WITH {_ATTACKS} SELECT doc_id, '<data-content source=\"' || {_HTML} || '\">' || chr(10) || {_ESCAPED.format('text')} || chr(10) || '</data-content>' AS wrapped FROM attack",
    "strip_markers": f"""WITH {_ATTACKS}, marked AS (SELECT doc_id, 'go [SANITIZED: name]' || CASE WHEN doc_id % 3 = 0 THEN '[SANITIZED: x:y]a' || chr(10) || 'b[/SANITIZED] ' || text ELSE text END || '[/SANITIZED] end' AS t FROM attack)
        SELECT doc_id, regexp_replace(t, '\\[SANITIZED:[^\\]]*\\](.*?)\\[/SANITIZED\\]', '\\1', 'gs') AS stripped FROM marked""",
    "risk_score": f"WITH {_base()}, {_REGEX} SELECT doc_id, round(least(sum({_WEIGHT}) / 100.0, 1.0)::DOUBLE, 2) AS risk_score FROM found GROUP BY doc_id",
    "risk_threshold": f"WITH {_ALL} SELECT doc_id, c AS n, round(s, 2) AS risk_score, marked, was_modified FROM judged",
    "sanitize_full": f"{_MARKED} SELECT doc_id, sanitized_text, detected, round(s, 2) AS risk_score, sha256(raw) AS content_hash, was_modified, source FROM cleaned JOIN attack USING (doc_id)",
    "audit_events": f"WITH {_ALL} SELECT source, sha256(raw) AS content_hash, '{spec.DETECTION_LAYER}' AS detection_layer, patterns, round(s, 2) AS risk_score, CASE WHEN was_modified THEN 'escaped' ELSE 'logged' END AS action_taken FROM judged JOIN attack USING (doc_id) WHERE c > 0",
    "source_risk_rollup": f"WITH {_ALL} SELECT source, count(*) AS texts, count(*) FILTER (c > 0) AS detected, count(*) FILTER (was_modified) AS modified, round(max(s), 2) AS highest FROM attack JOIN judged USING (doc_id) GROUP BY source",
    "sql_functions": f"""{_MARKED}, parts AS (
        SELECT doc_id, (SELECT count(*) FROM found WHERE found.doc_id = judged.doc_id)::INT AS regex, (SELECT count(*) FROM leet WHERE leet.doc_id = judged.doc_id)::INT AS leet,
               (SELECT count(*) FROM (SELECT doc_id FROM single UNION ALL SELECT doc_id FROM phrase) f WHERE f.doc_id = judged.doc_id)::INT AS fuzzy,
               round((SELECT least(coalesce(sum({_WEIGHT}), 0) / 100.0, 1.0)::DOUBLE FROM found WHERE found.doc_id = judged.doc_id), 2) AS risk_score FROM judged
    ) SELECT doc_id, regex, leet, fuzzy, risk_score, sanitized_text FROM parts JOIN cleaned USING (doc_id)""",
    "normalize_unicode": f"SELECT doc_id, CASE doc_id % {len(UNICODE)}" + "".join(f" WHEN {i} THEN {_q(made)}" for i, (_, made) in enumerate(UNICODE)) + f" END || ' ' || {_FOLD.format('text')} AS norm FROM documents",
    "conversation_scan": f"WITH {_base('conversations_planted', 'conv_id, turn', 'text', _planted('conversations', 'conv_id + turn', 'text', 3))}, {_scan('found', 'n', 'n', 'conv_id, turn', _SIGNAL)} SELECT conv_id, turn, pattern_name, matched_text, position, risk_level FROM found",
    "pages_scan": f"WITH {_base('pages_planted', 'page_id', 'html', _planted('pages', 'page_id', 'html', 2))}, {_scan('found', 'n', 'n', 'page_id')} SELECT page_id, pattern_name, matched_text, position, risk_level FROM found",
    "homoglyph_fold": "SELECT doc_id, true AS folds FROM documents",
}
