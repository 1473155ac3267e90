"""DuckDB SQL that gives the rows of the queries by plain joins and aggregates."""

from funnelworks.llm.licensescan import BAND, SHARE, TEMPLATES

_WS = r"[\x20\x09-\x0D]"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _fold(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def line_dedup_cte(docs: str) -> str:
    """CTEs up to ``deduped`` (doc_id, n_lines, n_dropped, kept) over rows (doc_id, text) of ``docs``."""
    return f"""
    lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs})),
    keyed AS (SELECT *, {_fold(f"trim(line, {_TRIM})")} AS key FROM lines),
    often AS (SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40
              GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    deduped AS (
      SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.holder <> k.doc_id) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.holder IS NULL OR o.holder = k.doc_id), '') AS kept
      FROM keyed k LEFT JOIN often o ON k.key = o.key GROUP BY k.doc_id)"""


OP5 = f"""WITH {line_dedup_cte("documents")}
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM deduped"""

OP7 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(20 + length(regexp_replace(role, '[\\<\[]', 'xx', 'g')) + length(regexp_replace(text, '[\\<\[]', 'xx', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id"""


def windows_cte(docs: str) -> str:
    """CTEs up to ``found`` (doc_id, n_words, n_hit, items) over rows (doc_id, text) of ``docs``."""
    def split(x: str) -> str:
        return rf"list_filter(regexp_split_to_array({_fold(f"coalesce({x}, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

    return rf"""
    dw AS (SELECT doc_id, {split('text')} AS w FROM {docs}),
    iw AS (SELECT item_id, {split('text')} AS w FROM benchmark),
    wins AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS win, least(len(w), 10) AS k
             FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT k FROM wins),
    dwin AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
             FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
    met AS (SELECT DISTINCT doc_id, i, d.k, item_id FROM dwin d JOIN wins USING (win) WHERE d.k = wins.k),
    spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY 1),
    its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM met) GROUP BY 1),
    found AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items
              FROM dw LEFT JOIN spots USING (doc_id) LEFT JOIN its USING (doc_id))"""


OP8 = f"""WITH {windows_cte("documents")}
SELECT doc_id, n_words, n_hit, n_items, sha256(items) AS items_sha256, n_hit > 0 AS contaminated FROM found"""


def quality_cte(docs: str) -> str:
    """CTEs up to ``judged`` (doc_id, measures, base_failed, kept, clean) over rows (doc_id, text, source) of ``docs``."""
    norm = f"lower(regexp_replace(trim(line, {_TRIM}), '{_WS}+', ' ', 'g'))"
    return rf"""
    q AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
    runs AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM q WHERE len(w) >= 3)),
    twice AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM runs) WHERE n > 1),
    again AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM twice GROUP BY 1),
    ql AS (SELECT doc_id, host, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM q),
    dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ql WHERE trim(line, {_TRIM}) <> '' GROUP BY 1),
    qh AS (SELECT *, CASE WHEN norm <> '' THEN ('0x' || substr(md5(norm), 1, 15))::BIGINT END AS h
           FROM (SELECT *, {norm} AS norm FROM ql)),
    pages AS (SELECT doc_id, host, list(norm ORDER BY pos) FILTER (WHERE norm <> '') AS page, list(DISTINCT h) FILTER (WHERE h IS NOT NULL) AS hs
              FROM qh GROUP BY 1, 2),
    hosts AS (SELECT host, count(DISTINCT page) AS n_docs FROM pages GROUP BY 1),
    held AS (SELECT host, page, unnest(hs) AS h FROM pages),
    over_limit AS (SELECT c.host, h FROM (SELECT host, h, count(DISTINCT page) AS n FROM held GROUP BY 1, 2) c
             JOIN hosts ON c.host IS NOT DISTINCT FROM hosts.host WHERE n >= 20 AND n * 100 > n_docs * 10),
    cleaned AS (SELECT qh.doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.h IS NULL), '') AS clean
             FROM qh LEFT JOIN over_limit o ON qh.h = o.h AND qh.host IS NOT DISTINCT FROM o.host GROUP BY 1),
    measured AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, clean,
        100 * length(clean) >= 20 * length(t) AS remains
      FROM q LEFT JOIN again USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN cleaned USING (doc_id)),
    judged AS (SELECT *, NOT base_failed AND remains AS kept FROM
      (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured))"""


OP10 = f"""WITH {quality_cte("documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, sha256(clean) AS clean_sha256 FROM judged"""

def jaccard_cte(docs: str) -> str:
    """CTEs up to ``comp`` (doc_id, n_shingles, component_id) over rows (doc_id, text) of ``docs``."""
    words = rf"regexp_extract_all({_fold("coalesce(text, '')")}, '[^\x20\x09-\x0D]+')"
    return rf"""
    jw AS (SELECT doc_id, {words} AS w FROM {docs}),
    sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
           FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM jw WHERE len(w) > 0)),
    sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
    linked AS (SELECT a, b FROM inter JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
    way AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM jw UNION SELECT r.a, w.b FROM reach r JOIN way w ON r.b = w.a),
    comp AS (SELECT doc_id, coalesce(n, 0) AS n_shingles, m AS component_id
             FROM (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) LEFT JOIN sz USING (doc_id))"""


OP9 = f"""WITH RECURSIVE {jaccard_cte("documents")}
SELECT doc_id, n_shingles, component_id FROM comp"""

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_CRC = """list_reduce([ord(x) FOR x IN string_split(conv_id::VARCHAR, '')], lambda a, b:
    list_reduce(range(8), lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), xor(a, b)), 4294967295)"""

OP11 = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor({_CRC}, 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (SELECT conv_id, 0 AS part, pos, said FROM heads JOIN (SELECT conv_id AS base, pos, said FROM turns) USING (base) WHERE pos <= h
          UNION ALL SELECT conv_id, 1, pos, said FROM heads JOIN turns USING (conv_id) WHERE pos > h),
whole AS (SELECT conv_id, coalesce(says, []) AS says FROM heads LEFT JOIN
          (SELECT conv_id, list(said ORDER BY part, pos) AS says FROM parts GROUP BY 1) USING (conv_id)),
path AS (SELECT conv_id, says, unnest(range(0, len(says) + 1)) AS depth FROM whole),
named AS (SELECT conv_id, depth, len(says) AS n, list_slice(says, 1, depth) AS node, CASE WHEN depth > 0 THEN list_slice(says, 1, depth - 1) END AS up FROM path),
nodes AS (SELECT node, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256,
  CASE WHEN any_value(depth) = 0 THEN 0 ELSE (count(*) - 1) * length(any_value(node[depth].text)) END AS own FROM named GROUP BY node),
kids AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON nodes.node = kids.node),
below AS (SELECT unnest(range(0, depth + 1)) AS up_to, node, n_children, own FROM counted),
sums AS (SELECT list_slice(node, 1, up_to) AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM below GROUP BY 1)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN sums ON c.node = sums.node LEFT JOIN nodes p ON c.up = p.node"""


def _templates() -> str:
    rows = ", ".join(f"({n}, '{t.label}', {t.phrase}, {t.k}, {t.words!r})" for n, t in enumerate(TEMPLATES))
    return f"(VALUES {rows}) AS v(template, label, phrase, k, ws)"


OP12 = f"""
WITH given AS (SELECT *, len(ws) - k + 1 AS grams FROM {_templates()}),
tg AS (SELECT template, k, i - 1 AS place, list_slice(ws, i, i + k - 1) AS g FROM (SELECT *, unnest(range(1, grams + 1)) AS i FROM given)),
w AS (SELECT doc_id, regexp_extract_all({_fold("coalesce(text, '')")}, {_WORDS}) AS ws FROM documents),
dg AS (SELECT doc_id, k, i - 1 AS pos, list_slice(ws, i, i + k - 1) AS g FROM
       (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM given))),
vote AS (SELECT DISTINCT doc_id, template, pos - place AS diagonal, place FROM dg JOIN tg USING (k, g)),
phrases AS (SELECT doc_id, label, diagonal FROM (SELECT doc_id, template, diagonal, count(*) AS n FROM vote GROUP BY ALL)
            JOIN given USING (template) WHERE phrase AND n = grams),
merged AS (SELECT a.doc_id, a.template, a.diagonal, count(DISTINCT b.place) AS n FROM (SELECT DISTINCT doc_id, template, diagonal FROM vote) a
           JOIN vote b ON a.doc_id = b.doc_id AND a.template = b.template AND abs(a.diagonal - b.diagonal) <= {BAND} GROUP BY ALL),
notices AS (SELECT doc_id, label, n::DOUBLE / grams AS share FROM merged JOIN given USING (template) WHERE NOT phrase AND n::DOUBLE / grams >= {SHARE}),
base AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM phrases GROUP BY 1),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM
          (SELECT doc_id, label, 1.0 AS share FROM phrases UNION ALL SELECT doc_id, label, share FROM notices) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)"""

OP13 = f"""
WITH dt AS (SELECT doc_id, unnest(regexp_extract_all({_fold("text")}, {_WORDS})) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY 1, 2),
ln AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY 1),
tot AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM ln),
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_fold("text")}, {_WORDS})) AS term FROM benchmark),
wt AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), tot),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * nn) // l) AS m FROM ln, tot),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM it JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50"""

ORACLES = {
    "op11_prefix_trie": OP11, "op12_license_scan": OP12, "op13_lexical_search": OP13,
    "op9_ngram_jaccard_join": OP9,
    "op5_line_dedup": OP5, "op7_chat_formatting": OP7, "op8_benchmark_decontamination": OP8, "op10_quality_rules": OP10,
}
