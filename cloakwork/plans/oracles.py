"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .queries import CONTEXT_NAMES, ENDS, NAME
from ..sources import seeds
from ..sources.locales import LOCALES

NOW = "TIMESTAMP '2024-01-30 00:00:00'"
EMAIL, CARD, IP, PHONE = (
    r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    r"\b[0-9]{16}\b",
    r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
)
ACCOUNT, TOKEN = r"@([A-Za-z0-9_]{3,50})\b", r'token = "([0-9a-f]{40})"'


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spans(pii_type: str, pattern: str, group: int = 0, after: int = 0, source: str = "documents") -> str:
    """Spans of a pattern; ``after`` characters of a match follow its group."""
    p = quoted(pattern)
    total = lambda name: f"coalesce(list_sum(list_transform({name}[1:i], lambda x: length(x))), 0)"
    return f"""
    SELECT doc_id, CAST({total("gaps")} + {total("whole")} - {after} - length(part[i]) AS BIGINT) AS "start",
           CAST({total("gaps")} + {total("whole")} - {after} AS BIGINT) AS "end", '{pii_type}' AS pii_type, part[i] AS value
    FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i
          FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS whole, regexp_extract_all(text, {p}, {group}) AS part, regexp_split_to_array(text, {p}) AS gaps FROM {source})
          WHERE len(whole) > 0) AS found"""


#: Whole runs of word characters of the form of a bank code.
BIC = r"""
    SELECT doc_id, "start", "end", 'BIC' AS pii_type, value
    FROM (""" + spans("BIC", r"[\p{L}\p{N}_]+") + r""") WHERE regexp_full_match(value, '[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?')"""


def union(*parts: str) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


RAW = union(spans("EMAIL", EMAIL), spans("CREDIT_CARD", CARD), spans("IP_ADDRESS", IP), spans("PHONE", PHONE))


def merged(raw: str, gap: int = 5) -> str:
    """Neighbours of one type over at most ``gap`` characters without a newline, as one."""
    return f"""
  raw AS ({raw}),
  linked AS (
    SELECT r.*, CASE WHEN lag(pii_type) OVER w = pii_type AND r."start" - lag("end") OVER w BETWEEN 1 AND {gap}
                      AND NOT contains(substr(text, CAST(lag("end") OVER w + 1 AS BIGINT), CAST(r."start" - lag("end") OVER w AS BIGINT)), chr(10)) THEN 0 ELSE 1 END AS fresh
    FROM raw r JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY r."start")),
  islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY "start") AS island FROM linked),
  merged AS (
    SELECT doc_id, min("start") AS "start", max("end") AS "end", any_value(pii_type) AS pii_type FROM islands GROUP BY doc_id, island)"""


TAGGED = (
    "WITH"
    + merged(RAW)
    + """,
  spanned AS (SELECT m.*, substr(text, m."start" + 1, m."end" - m."start") AS value, lower(trim(substr(text, m."start" + 1, m."end" - m."start"))) AS key
              FROM merged m JOIN documents USING (doc_id)),
  firsts AS (SELECT doc_id, key, min("start") AS first, arg_min(pii_type, "start") AS first_type FROM spanned GROUP BY doc_id, key),
  numbered AS (SELECT *, '[' || first_type || '_' || row_number() OVER (PARTITION BY doc_id, first_type ORDER BY first) || ']' AS token FROM firsts),
  tokens AS (SELECT s.*, token FROM spanned s JOIN numbered USING (doc_id, key)),
  pieces AS (SELECT t.*, substr(text, CAST(coalesce(lag("end") OVER w, 0) + 1 AS BIGINT), CAST(t."start" - coalesce(lag("end") OVER w, 0) AS BIGINT)) || token AS piece
             FROM tokens t JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY t."start")),
  rebuilt AS (SELECT doc_id, string_agg(piece, '' ORDER BY "start") AS head, max("end") AS stop, count(*) AS n, string_agg(DISTINCT pii_type, ' ' ORDER BY pii_type) AS types
              FROM pieces GROUP BY doc_id)
"""
)

RESOLVED = f"""
WITH names AS (SELECT {list(CONTEXT_NAMES)} AS n),
  asked AS (SELECT doc_id, n[CAST(doc_id % 7 + 1 AS INT)] AS context_type,
                   CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN 'surrogate' END AS own_mode, doc_id % 5 = 0 AS inline FROM documents, names),
  contexts(code, domain, default_mode) AS (VALUES {", ".join(f"('{c}', '{d}', '{'surrogate' if c in seeds.SURROGATE_CONTEXTS else 'tag'}')" for c, d in seeds.CONTEXTS.items())}),
  policies(domain, protect, keep) AS (VALUES {", ".join(f"('{d}', {p.split()}, {k.split()})" for d, (p, k) in seeds.POLICIES.items())}),
  resolved AS (SELECT doc_id, context_type, coalesce(nullif(own_mode, ''), default_mode, 'tag') AS mode,
                      CASE WHEN inline THEN ['EMAIL'] ELSE protect END AS protect, coalesce(keep, []) AS keep
               FROM asked LEFT JOIN contexts ON code = context_type LEFT JOIN policies USING (domain))
"""

CITIZENS = """
WITH c AS (
  SELECT c_custkey, ['Rossi','Verdi','Fo','D''Angelo','Bianchi','Aiello'][CAST(c_custkey % 6 + 1 AS INT)] AS last,
         ['Maria','Francesco','Al','Gianluca','Io'][CAST(c_custkey * 3 % 5 + 1 AS INT)] AS first,
         CAST(DATE '1950-01-01' + CAST(c_custkey * 37 % 18000 AS INT) AS DATE) AS birth,
         CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         ['H501','F205','H223','H501'][CAST(c_custkey % 4 + 1 AS INT)] AS town FROM customer),
  l AS (SELECT *, regexp_replace(upper(last), '[^A-Z]|[AEIOU]', '', 'g') AS lc, regexp_replace(upper(last), '[^AEIOU]', '', 'g') AS lv,
               regexp_replace(upper(first), '[^A-Z]|[AEIOU]', '', 'g') AS fc, regexp_replace(upper(first), '[^AEIOU]', '', 'g') AS fv FROM c),
  p AS (SELECT *, left(lc || lv || 'XXX', 3) || CASE WHEN length(fc) >= 4 THEN fc[1] || fc[3:4] ELSE left(fc || fv || 'XXX', 3) END
               || right('0' || (year(birth) % 100), 2) || 'ABCDEHLMPRST'[month(birth)]
               || right('0' || (day(birth) + CASE WHEN gender = 'F' THEN 40 ELSE 0 END), 2) || town AS partial FROM l),
  k AS (SELECT *, list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 0
          THEN strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', partial[i]) - 1
          ELSE [1,0,5,7,9,13,15,17,19,21,1,0,5,7,9,13,15,17,19,21,2,4,18,20,11,3,6,8,12,14,16,10,22,25,24,23][strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', partial[i])] END)) AS total FROM p),
  coded AS (SELECT c_custkey, partial || chr(CAST(total % 26 + 65 AS INT)) AS cf FROM k)
"""



def hashed(salt: str, digits: int = 8) -> str:
    """A number from the first hexadecimal digits of the SHA-256 of key and salt."""
    return f"('0x' || left(sha256(key || '|{salt}'), {digits}))::BIGINT"


def chosen(values: str, salt: str) -> str:
    return f"{values}[{hashed(salt)} % len({values}) + 1]"


def filled(form: str, salt: str) -> str:
    byte = f"('0x' || substr(sha256(key || '|{salt}'), 2 * (i % 32) + 1, 2))::INT"
    one = f"CASE substr({form}, i + 1, 1) WHEN '#' THEN ({byte} % 10)::VARCHAR WHEN '?' THEN chr({byte} % 26 + 65) ELSE substr({form}, i + 1, 1) END"
    return f"list_aggregate([{one} for i in range(length({form}))], 'string_agg', '')"


def remainder97(text: str) -> str:
    """The remainder by 97 of a text in which letters stand for two digits."""
    number = f"list_aggregate([CASE WHEN x BETWEEN '0' AND '9' THEN x ELSE (ascii(x) - 55)::VARCHAR END for x in string_split({text}, '')], 'string_agg', '')"
    return f"list_reduce(list_prepend(0::BIGINT, [d::BIGINT for d in string_split({number}, '')]), lambda a, d: (a * 10 + d) % 97)"


def texts_of(values: list[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


SURROGATE_LOCALES = f"""
WITH tables(place, locale, firsts, lasts, towns, streets, address, phones, country, account) AS (VALUES {", ".join(f"({i}, '{n}', {texts_of(x.first_names)}, {texts_of(x.last.split())}, {texts_of(x.towns.split(','))}, {texts_of(x.streets.split(','))}, {quoted(x.address)}, {texts_of(list(x.phones))}, '{x.country}', '{x.account}')" for i, (n, x) in enumerate(LOCALES.items()))}),
  keyed AS (SELECT *, c_name || '|ctx|' || locale AS key FROM customer JOIN tables ON c_custkey % {len(LOCALES)} = place),
  made AS (SELECT *, {chosen("firsts", "first")} || ' ' || {chosen("lasts", "last")} AS person, {chosen("towns", "town")} AS city, {chosen("phones", "phone")} AS form,
                  {filled("address", "address")} AS place_form, {filled("account", "account")} AS number FROM keyed),
  checked AS (SELECT *, {remainder97("(number || country || '00')")} AS r FROM made),
  whole AS (SELECT *, country || right('0' || (98 - r), 2) || number AS iban FROM checked)
SELECT c_custkey, locale, person, city, {filled("form", "line")} AS phone, iban,
       replace(replace(replace(place_form, '{{street}}', {chosen("streets", "street")}), '{{number}}', ({hashed("number")} % 254 + 1)::VARCHAR), '{{town}}', city) AS address,
       {remainder97("(iban[5:] || iban[:4])")} AS remainder
FROM whole"""

def digits(salt: str, n: int) -> str:
    return f"lpad(({hashed(salt, 15)} % {10**n})::VARCHAR, {n}, '0')"


US = LOCALES["en_US"]
#: Every second digit from the second on is doubled and its digits are added.
LUHN = "((10 - list_sum([CASE WHEN i % 2 = 0 THEN substr(body, i + 1, 1)::INT ELSE substr(body, i + 1, 1)::INT * 2 % 10 + substr(body, i + 1, 1)::INT // 5 END for i in range(length(body))]) % 10) % 10)::VARCHAR"
SURROGATE_SIMPLE = f"""
WITH found AS (SELECT DISTINCT pii_type, value AS text FROM ({RAW})),
  keyed AS (SELECT *, text || '|corpus|en_US' AS key FROM found),
  parts AS (SELECT *, {chosen(texts_of(US.first_names), "first")} AS first, {chosen(texts_of(US.last.split()), "last")} AS last, '04' || {digits("card", 14)} AS body, {chosen(texts_of(list(US.phones)), "phone")} AS form FROM keyed)
SELECT 'corpus' AS context_id, pii_type, text, sha256(text) AS real_hash,
       CASE pii_type WHEN 'EMAIL' THEN lower(left(first, 1) || '.' || last) || {digits("user", 2)} || '@' || substr(text, strpos(text, '@') + 1)
                     WHEN 'CREDIT_CARD' THEN substr(body, 2) || {LUHN}
                     WHEN 'IP_ADDRESS' THEN '10.' || ({hashed("ip0")} % 254 + 1) || '.' || ({hashed("ip1")} % 254 + 1) || '.' || ({hashed("ip2")} % 254 + 1)
                     ELSE {filled("form", "line")} END AS fake_value
FROM parts"""

LAYERED = "WITH mails AS (" + spans("EMAIL", EMAIL) + "), runs AS (" + spans("URL", r"[^ \n\r\t]*@[^ \n\r\t]*") + "), numbers AS (" + spans("IP_ADDRESS", IP) + """)
SELECT doc_id, "start", "end", pii_type, 'regex' AS source FROM mails
UNION ALL SELECT doc_id, "start", "end", pii_type, 'mail' FROM runs r WHERE NOT EXISTS (SELECT 1 FROM mails m WHERE m.doc_id = r.doc_id AND m."start" < r."end" AND r."start" < m."end")
UNION ALL SELECT doc_id, "start", "end", pii_type, 'model' FROM numbers n WHERE NOT EXISTS (SELECT 1 FROM runs m WHERE m.doc_id = n.doc_id AND m."start" < n."end" AND n."start" < m."end")"""

CLASSES = ", ".join(f"('{label}', {quoted(code) if code else 'NULL'})" for label, code in seeds.CLASSIFIER_LABELS.items())
NAMED = spans("PERSON", NAME)


def model_rows(labels: str) -> str:
    size = len(labels.split())
    return f"""(SELECT n.*, ['{"','".join(labels.split())}'][CAST((doc_id + "start") % {size} + 1 AS INT)] AS label, ((doc_id + "start") * 37 % 100) / 100.0::DOUBLE AS score FROM ({NAMED}) n)"""


MODEL_ROWS = model_rows("FIRSTNAME JOBTITLE EMAIL NEWLABEL IPV4 ZIPCODE AGE")
BEFORE = """lower(substr(text, CAST(greatest("start" - 60, 0) + 1 AS BIGINT), CAST(least("start", 60) AS BIGINT)))"""
AUDIT = "(SELECT event_id AS id, event_type AS action, CAST(user_id AS VARCHAR) AS context_id, ts AS created_at FROM events)"
ORDERS = "(SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price FROM orders)"
ORACLES = {
    "regex_spans_email": spans("EMAIL", EMAIL),
    "regex_spans_ip": spans("IP_ADDRESS", IP),
    "regex_spans_card": spans("CREDIT_CARD", CARD),
    "regex_spans_bic": BIC,
    "regex_spans_token_group": spans("SECRET", TOKEN, 1, 1),
    "spans_all_raw": f"SELECT pii_type, count(*) AS cnt FROM ({union(RAW, spans('ACCOUNT', ACCOUNT, 1))}) GROUP BY pii_type",
    # No span that is dropped here overlaps a later one that isn't inside the same mail address.
    "spans_merged_overlap": f"""
WITH raw AS ({union(spans("EMAIL", EMAIL), spans("ACCOUNT", ACCOUNT, 1), spans("IP_ADDRESS", IP))})
SELECT * FROM raw r WHERE NOT EXISTS (
  SELECT 1 FROM raw o WHERE o.doc_id = r.doc_id AND o."start" < r."end" AND r."start" < o."end"
    AND (o."start" < r."start" OR (o."start" = r."start" AND o."end" > r."end")))""",
    "spans_merged_adjacent": "WITH" + merged(BIC) + """
SELECT doc_id, m."start", m."end", pii_type, substr(text, m."start" + 1, m."end" - m."start") AS value FROM merged m JOIN documents USING (doc_id)""",
    "reclassify_by_context": f"""
WITH raw AS ({union(spans("IP_ADDRESS", IP), spans("CREDIT_CARD", CARD))})
SELECT doc_id, r."start", r."end", value,
       CASE WHEN pii_type = 'IP_ADDRESS' AND regexp_matches(substr(text, greatest(r."start" - 20, 0) + 1, r."start" - greatest(r."start" - 20, 0)), '[aeiou]\\s$') THEN 'HOST' ELSE pii_type END AS pii_type
FROM raw r JOIN documents USING (doc_id) WHERE NOT (pii_type = 'CREDIT_CARD' AND regexp_matches(value, '^4[0-4]'))""",
    "denylist_exact": f"SELECT * FROM ({NAMED}) WHERE lower(value) NOT IN ('the', 'of', 'in', 'and', 'to', 'der', 'la', 'de')",
    "denylist_contains": f"SELECT * FROM ({NAMED}) WHERE NOT contains(lower(value), 'th') AND NOT contains(lower(value), 'ion')",
    "context_boost": f"""
WITH s AS (SELECT doc_id, "start", round(((doc_id + "start") % 10) / 10.0::DOUBLE, 1) AS score, {BEFORE} AS before FROM ({NAMED}) JOIN documents USING (doc_id))
SELECT doc_id, "start", score FROM (SELECT doc_id, "start", CASE WHEN contains(before, 'the ') OR contains(before, 'der ') THEN greatest(score, 0.9) ELSE score END AS score FROM s) WHERE score >= 0.65""",
    "snap_boundary": f"""
WITH a AS (SELECT doc_id, text, "start" - length(regexp_extract(substr(text, 1, "start"), '[A-Za-z0-9_]*$')) AS s, "end" + length(regexp_extract(substr(text, "end" + 1), '^[A-Za-z0-9_]*')) AS e
           FROM ({spans("ADDRESS", ENDS)}) JOIN documents USING (doc_id))
SELECT doc_id, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", 'ADDRESS' AS pii_type, substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS value FROM a""",
    # A chain is a B and the I and E of its label that follow at once, or an S alone.
    "bioes_collapse": f"""
WITH t AS (SELECT doc_id, "start", "end", ("start" % 64) / 128.0::DOUBLE AS score,
                  ['B-a','I-a','E-a','O','S-b','I-b','B-b','E-b','B-a','I-b'][CAST((doc_id * 7 + (row_number() OVER (PARTITION BY doc_id ORDER BY "start") - 1) * (doc_id % 3 + 1)) % 10 + 1 AS INT)] AS tag FROM ({NAMED})),
  l AS (SELECT *, tag[1] AS kind, tag[3:] AS label, lag(tag) OVER w AS last FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY "start")),
  c AS (SELECT *, sum(CASE WHEN kind IN ('I', 'E') AND last[1] IN ('B', 'I') AND last[3:] = label THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY "start") AS chain FROM l)
SELECT doc_id, min("start") AS "start", max("end") AS "end", any_value(label) AS label, round(avg(score), 4) AS score FROM c GROUP BY doc_id, chain HAVING arg_min(kind, "start") IN ('B', 'S')""",
    "label_map_threshold": f"""
WITH labels_of(label, code) AS (VALUES {CLASSES})
SELECT doc_id, "start", CASE WHEN l.label IS NULL THEN 'SECRET' ELSE code END AS pii_type, score
FROM {MODEL_ROWS} m LEFT JOIN labels_of l USING (label) WHERE score >= 0.7 AND (l.label IS NULL OR code IS NOT NULL)""",
    "external_layer_spans": f"""
WITH labels_of(label, code) AS (VALUES {CLASSES})
SELECT doc_id, "start", "end", CASE WHEN l.label IS NULL THEN 'SECRET' ELSE code END AS pii_type, value
FROM {MODEL_ROWS} m LEFT JOIN labels_of l USING (label) JOIN documents USING (doc_id) WHERE score >= 0.7 AND (l.label IS NULL OR code IS NOT NULL) AND length(text) >= 200""",
    "analyzer_layer_spans": f"""
WITH labels_of(label, code) AS (VALUES ('PERSON', 'PERSON'), ('EMAIL_ADDRESS', 'EMAIL'), ('DATE_TIME', 'DATE'), ('URL', 'URL')),
  s AS (SELECT doc_id, "start", "end", code AS pii_type, score, {BEFORE} AS before FROM {model_rows("PERSON LOCATION EMAIL_ADDRESS DATE_TIME URL")} JOIN labels_of USING (label) JOIN documents USING (doc_id))
SELECT * FROM (SELECT doc_id, "start", "end", pii_type,
                      CASE WHEN pii_type = 'PERSON' AND (contains(before, 'the ') OR contains(before, 'der ')) OR pii_type = 'EMAIL' AND contains(before, ' de ') THEN greatest(score, 0.9) ELSE score END AS score FROM s) WHERE score >= 0.65""",
    "mappings_by_context": f"SELECT id, context_id, 'value ' || id AS original FROM {AUDIT} WHERE id % 4 <> 0 AND context_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 2 = 0)",
    "setting_or_default": "SELECT coalesce(max(CASE WHEN c_name = 'Customer#000000007' THEN 'v' || c_custkey END), 'none') AS known, 'it' AS unknown FROM customer",
    "audit_sink_rows": TAGGED + f"""
SELECT sha256('anonymize|' || source || '|' || doc_id || '|2024-01-30 00:00:00') AS id, 'anonymize' AS action, source AS context_id, coalesce(types, '') AS types, CAST(length(text) AS BIGINT) AS char_count
FROM documents LEFT JOIN rebuilt USING (doc_id)""",
    "insert_new_keys": f"SELECT id, cust, status FROM {ORDERS}",
    "audit_total": f"SELECT count(*) AS total FROM {AUDIT} WHERE action = 'purchase'",
    "api_key_count": "SELECT count(*) AS keys FROM customer",
    "key_last_used": f"""
SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN greatest(TIMESTAMP '2024-01-15 00:00:00', coalesce(latest, TIMESTAMP '2024-01-15 00:00:00')) ELSE TIMESTAMP '2024-01-15 00:00:00' END AS last_used_at
FROM customer LEFT JOIN (SELECT context_id, max(created_at) AS latest FROM {AUDIT} GROUP BY context_id) ON context_id = CAST(c_custkey AS VARCHAR)""",
    "name_keys": "SELECT c_custkey, lower(c_name) || ' de la ' || c_custkey AS key FROM customer",
    "surrogate_cache_join": f"""
SELECT DISTINCT pii_type, value AS text, 'fake ' || value AS fake_value FROM ({RAW}) WHERE length(value) % 2 = 0""",
    "profile_join": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS context_id, c_name AS text, CASE WHEN c_custkey % 2 = 0 THEN 'Ada N' || c_custkey END AS fake_value FROM customer",
    "policy_resolve": RESOLVED + """
SELECT doc_id, context_type, mode, array_to_string(list_sort(protect), ' ') AS protect, array_to_string(list_sort(keep), ' ') AS keep, '' AS surrogate FROM resolved""",
    "policy_filter": RESOLVED + f"""
SELECT s.* FROM ({union(spans("EMAIL", EMAIL), spans("CREDIT_CARD", CARD), spans("IP_ADDRESS", IP))}) s JOIN resolved USING (doc_id)
WHERE NOT list_contains(keep, pii_type) AND (protect IS NULL OR list_contains(protect, pii_type))""",
    "tag_tokens": TAGGED + 'SELECT doc_id, "start", "end", token FROM tokens',
    "anonymize_tag": TAGGED + """
SELECT doc_id, CASE WHEN head IS NULL THEN text ELSE head || substr(text, CAST(stop + 1 AS BIGINT)) END AS anonymized_text, coalesce(n, 0) AS entity_count, coalesce(types, '') AS types
FROM documents LEFT JOIN rebuilt USING (doc_id)""",
    "mapping_rows_dedup": TAGGED + """
SELECT context_id, 'case_file' AS context_type, token, original, pii_type FROM (
  SELECT source AS context_id, token, value AS original, pii_type, row_number() OVER (PARTITION BY source, token ORDER BY doc_id, "start" DESC) AS n FROM tokens JOIN documents USING (doc_id)) WHERE n = 1""",
    "deanonymize_roundtrip": "SELECT doc_id, text AS restored_text FROM documents",
    "insert_if_absent": f"""
WITH there AS (SELECT min(id) AS id, cust, status FROM {ORDERS} WHERE id % 3 = 0 GROUP BY cust, status)
SELECT * FROM there UNION ALL SELECT max(id) AS id, cust, status FROM {ORDERS} o WHERE NOT EXISTS (SELECT 1 FROM there t WHERE t.cust = o.cust AND t.status = o.status) GROUP BY cust, status""",
    "upsert_last_wins": f"""
WITH new AS (SELECT cust, arg_max(status || ' ' || id, id) AS value FROM {ORDERS} GROUP BY cust)
SELECT coalesce(n.cust, c_custkey) AS cust, coalesce(value, 'none') AS value FROM customer FULL JOIN new n ON n.cust = c_custkey""",
    "partial_update": f"SELECT id, cust, CASE WHEN id % 2 = 0 AND cust % 2 = 0 THEN 'X' ELSE status END AS status FROM {ORDERS}",
    "bulk_delete_anti": f"SELECT id, cust, status FROM {ORDERS} WHERE NOT price > 200000",
    "bulk_delete_count": f"SELECT count(*) AS deleted FROM {ORDERS} WHERE price > 200000",
    "ttl_delete": f"SELECT id, action, context_id FROM {AUDIT} WHERE created_at >= {NOW} - INTERVAL 10 DAY",
    "stats_breakdown": f"SELECT action, count(*) AS cnt FROM {AUDIT} GROUP BY action",
    "stats_summary": f"""
SELECT count(*) FILTER (action = 'click') AS total_requests, count(*) AS total_mappings, count(*) FILTER (created_at >= {NOW} - INTERVAL 24 HOUR) AS requests_last_24h,
       (SELECT string_agg(action || '=' || n, ' ' ORDER BY action) FROM (SELECT action, count(*) AS n FROM {AUDIT} GROUP BY action)) AS by_type FROM {AUDIT}""",
    "requests_last_24h": f"SELECT count(*) AS requests FROM {AUDIT} WHERE created_at >= {NOW} - INTERVAL 24 HOUR",
    "audit_page": f"SELECT id, action, context_id FROM {AUDIT} WHERE action = 'purchase' ORDER BY created_at DESC, id LIMIT 20 OFFSET 40",
    "mapping_page": f"SELECT id, CASE WHEN id % 4 = 0 THEN '***' ELSE 'value ' || id END AS original FROM {AUDIT} ORDER BY created_at DESC, id LIMIT 40 OFFSET 40",
    "distribution_normalised": f"SELECT action, cnt, cnt / max(cnt) OVER () AS share FROM (SELECT action, count(*) AS cnt FROM {AUDIT} GROUP BY action)",
    "requests_by_window": f"""
SELECT window_start, count(*) AS requests FROM (
  SELECT unnest(range(date_trunc('hour', created_at) - INTERVAL 23 HOUR, created_at + INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS window_start FROM {AUDIT}) GROUP BY window_start""",
    "sha_seed": """
SELECT c_custkey, sha256(c_name) AS hash, left(sha256(c_name || '|' || c_custkey), 16) AS hex,
       CAST(CAST('0x' || left(sha256(c_name || '|' || c_custkey), 16) AS UBIGINT) AS VARCHAR) AS seed FROM customer""",
    "cf_encode": CITIZENS + "SELECT c_custkey, cf FROM coded",
    "cf_decode": CITIZENS + """
SELECT c_custkey, CASE WHEN ok THEN cf[7:8] END AS year2, CASE WHEN ok THEN CAST(strpos('ABCDEHLMPRST', cf[9]) AS VARCHAR) END AS month,
       CASE WHEN ok THEN CAST(CAST(cf[10:11] AS INT) - CASE WHEN CAST(cf[10:11] AS INT) > 40 THEN 40 ELSE 0 END AS VARCHAR) END AS day,
       CASE WHEN ok THEN CASE WHEN CAST(cf[10:11] AS INT) > 40 THEN 'F' ELSE 'M' END END AS gender, CASE WHEN ok THEN cf[12:15] END AS belfiore
FROM (SELECT *, c_custkey % 9 <> 0 AS ok FROM coded)""",
    "luhn_imei": """
WITH b AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 + 12345 AS VARCHAR), 14, '3') AS body FROM customer)
SELECT c_custkey, body || CAST((10 - list_sum(list_transform(range(1, 15), lambda i: CASE WHEN i % 2 = 1 THEN CAST(body[i] AS INT) WHEN CAST(body[i] AS INT) > 4 THEN 2 * CAST(body[i] AS INT) - 9 ELSE 2 * CAST(body[i] AS INT) END)) % 10) % 10 AS VARCHAR) AS imei FROM b""",
    "salary_parse": """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN TRY_CAST(replace(format('{:,}', c_custkey * 1000), ',', '.') AS DOUBLE) WHEN c_custkey % 3 = 1 THEN CAST(c_custkey || '500.25' AS DOUBLE) END AS amount FROM customer""",
    "date_shift_fixed": """
WITH d AS (SELECT c_custkey, c_custkey % 5 AS kind, CAST(DATE '2020-01-01' + CAST(c_custkey % 900 + c_custkey % 330 + 30 AS INT) AS DATE) AS later FROM customer)
SELECT c_custkey, CASE WHEN kind = 4 THEN '3 marzo 2024' WHEN kind = 0 THEN strftime(later, '%d/%m/%Y') WHEN kind = 1 THEN strftime(later, '%Y-%m-%d') WHEN kind = 2 THEN strftime(later, '%d-%m-%Y') ELSE strftime(later, '%d.%m.%Y') END AS shifted FROM d""",
    "locale_lookup": "SELECT c_custkey, ['it_IT','en_US','en_GB','en_US','ro_RO'][CAST(c_custkey % 5 + 1 AS INT)] AS locale FROM customer",
    "precision_recall": f"""
WITH truth AS (SELECT doc_id, "start", "end", pii_type FROM ({union(spans("EMAIL", EMAIL), spans("IP_ADDRESS", IP), spans("CREDIT_CARD", CARD))})),
  found AS (SELECT doc_id, "start", "end", pii_type FROM ({union(spans("EMAIL", r"[a-z]+[.][0-9]+@mail[1-5][.]example[.]com"), spans("IP_ADDRESS", IP), spans("CREDIT_CARD", r"\b4[0-9]{14}[0-4]\b"))})),
  c AS (SELECT coalesce(f.pii_type, t.pii_type) AS pii_type, count(*) FILTER (f.doc_id IS NOT NULL AND t.doc_id IS NOT NULL) AS tp, count(*) FILTER (t.doc_id IS NULL) AS fp, count(*) FILTER (f.doc_id IS NULL) AS fn
        FROM found f FULL JOIN truth t ON f.doc_id = t.doc_id AND f."start" = t."start" AND f."end" = t."end" AND f.pii_type = t.pii_type GROUP BY 1)
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall,
       CASE WHEN tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1 FROM c""",
    "authorised_requests": "SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 3 = 0 AND c_custkey % 5 <> 0",
    "config_listing": """SELECT id, code, true AS enabled, row_number() OVER (PARTITION BY code ORDER BY id) AS place
FROM (SELECT p_partkey AS id, 'TYPE_' || (p_partkey % 7) AS code FROM part WHERE p_partkey % 3 <> 0)""",
    "surrogate_locales": SURROGATE_LOCALES,
    "surrogate_simple": SURROGATE_SIMPLE,
    "surrogate_leaks": TAGGED + "SELECT d.doc_id AS nth, coalesce(n, 0)::BIGINT AS entities, 0::BIGINT AS in_clear, n IS NULL AS unchanged FROM documents d LEFT JOIN rebuilt USING (doc_id)",
    "deanonymize_surrogates": "SELECT doc_id, text AS restored_text FROM documents",
    "layers_by_priority": LAYERED,
    "surrogates_longest_first": "SELECT c_custkey, c_name AS fake_value, rank() OVER (PARTITION BY length(c_name) ORDER BY c_name) AS rank FROM customer",
}
