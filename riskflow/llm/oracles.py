"""DuckDB SQL for the numbered operators that SQL can express."""
from __future__ import annotations

from riskflow.llm import quality_rules as qr
from riskflow.llm import url_filters as uf

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def url_filters(rules: list[tuple[str, str, str]]) -> str:
    rule, verdict = "NULL", "NULL"
    fits = []
    for say, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits.append((f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, say))
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ctes = [rf"""p0 AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)""",
            r"""p1 AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM p0)""",
            rf"""p2 AS (SELECT page_id, url, translate(raw, '{upper}', '{lower}') AS host,
                 regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM p1)""",
            r"""t0 AS (SELECT page_id, host, path, string_split(regexp_replace(path, '^/', ''), '/') AS s, '' AS template FROM p2)"""]
    for d in range(1, uf.DEPTH + 1):
        seg = f"CASE WHEN len(s) > {d - 1} THEN " + (f"array_to_string(s[{d}:], '/')" if d == uf.DEPTH else f"s[{d}]") + " END"
        num = r"regexp_matches(seg, '^[0-9]+(\.[A-Za-z][A-Za-z0-9]{0,5})?$')"
        ctes += [f"""s{d} AS (SELECT *, {seg} AS seg FROM t{d - 1})""",
                 f"""c{d} AS (SELECT host, template, seg, count(*) AS n FROM s{d} WHERE seg <> '' AND NOT {num} GROUP BY 1, 2, 3)""",
                 f"""w{d} AS (SELECT host, template, TRUE AS wide FROM c{d} GROUP BY 1, 2
                     HAVING count(*) >= {uf.MIN_CHILDREN} AND count(*) >= {uf.CHILD_SHARE} * sum(n))""",
                 rf"""t{d} AS (SELECT page_id, x.host, path, s, CASE WHEN seg IS NULL THEN x.template
                     ELSE x.template || '/' || CASE WHEN seg = '' THEN ''
                     WHEN {num} OR wide THEN '*' || regexp_extract(seg, '(\.[A-Za-z][A-Za-z0-9]{{0,5}})$', 1) ELSE seg END END AS template
                     FROM s{d} x LEFT JOIN w{d} w ON x.host = w.host AND x.template = w.template)"""]
    last = f"t{uf.DEPTH}"
    ctes += [r"""lab AS (SELECT page_id, count(*) AS labelled, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
                 FROM p2 JOIN labels l ON l.doc_id = try_cast(regexp_extract(url, '/([0-9]+)[^/]*/?(?:[?#]|$)', 1) AS BIGINT) GROUP BY 1)""",
             f"""cnt AS (SELECT host, template, coalesce(sum(labelled), 0) AS labelled, coalesce(sum(bad), 0) AS bad
                 FROM {last} LEFT JOIN lab USING (page_id) GROUP BY 1, 2)""",
             """tot AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(bad) / sum(labelled) ELSE 0 END AS overall FROM cnt)""",
             r"""sh AS (SELECT *, regexp_replace(template, '^/[^*/][^/]*', '/{}') AS shape FROM cnt)""",
             """po AS (SELECT *, sum(labelled) OVER (PARTITION BY host, shape) AS pl, sum(bad) OVER (PARTITION BY host, shape) AS pb FROM sh)""",
             f"""br AS (SELECT host, template, labelled, bad, CASE WHEN labelled = 0 OR abs(bad / greatest(labelled, 1) - pb / pl)
                 <= {uf.SIMILAR_Z} * sqrt((pb / pl) * (1 - pb / pl) / greatest(labelled, 1)) THEN shape ELSE template END AS branch FROM po)""",
             f"""ve AS (SELECT host, template, (sum(bad) OVER (PARTITION BY host, branch) + {uf.PRIOR} * overall)
                 / (sum(labelled) OVER (PARTITION BY host, branch) + {uf.PRIOR}) > {uf.BAD_RATE} AS rejected FROM br, tot)"""]
    return f"""WITH {', '.join(ctes)}
    SELECT page_id, x.host, path, {rule.replace('host', 'x.host')} AS rule,
    coalesce({verdict.replace('host', 'x.host')}, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, x.template
    FROM {last} x LEFT JOIN ve v ON x.host = v.host AND x.template = v.template"""


def quality(columns: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept") -> str:
    rates = ", ".join(f"sum(f_{r}) AS f_{r}" for r in ("base", "symbols", "dup_lines", "word_length"))
    names = ("base", "symbols", "dup_lines", "word_length")
    prior = ", ".join(f"avg(f_{r} / n) AS m_{r}, var_pop(f_{r} / n) AS v_{r}" for r in names)
    k = {r: f"CASE WHEN v_{r} > 0 THEN least(1000.0, greatest(2.0, m_{r} * (1 - m_{r}) / v_{r} - 1)) ELSE 1000.0 END" for r in names}
    shrunk = ", ".join(f"(f_{r} + m_{r} * ({k[r]})) / (n + ({k[r]}))" for r in names)
    return rf"""WITH d0 AS (SELECT *, {WORDS} AS w, coalesce(text, '') AS t FROM documents),
    win AS (SELECT doc_id, i, array_to_string(w[i:i + {qr.SPAN - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {qr.SPAN - 2})) AS i FROM d0)),
    rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    cov AS (SELECT doc_id, sum(step) AS n_repeat FROM (SELECT doc_id, least({qr.SPAN}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {qr.SPAN})) AS step FROM rep) GROUP BY 1),
    d1 AS (SELECT d0.*, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
        coalesce(n_repeat, 0)::BIGINT AS n_repeat_words FROM d0 LEFT JOIN cov USING (doc_id)),
    d2 AS (SELECT *, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines FROM d1),
    d3 AS (SELECT *, (n_words < {qr.MIN_WORDS} OR 100 * n_repeat_words > {qr.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
        10 * n_symbols > n_words AS s1, n_dup_lines >= 3 AS s2, (word_chars < 3 * n_words OR word_chars > 10 * n_words) AS s3 FROM d2),
    f AS (SELECT source, 1 AS one, base_failed::INT AS f_base, s1::INT AS f_symbols, s2::INT AS f_dup_lines, s3::INT AS f_word_length FROM d3),
    per AS (SELECT source AS host, count(*) AS n, {rates} FROM f GROUP BY 1),
    pri AS (SELECT {prior} FROM per),
    hv AS (SELECT host, greatest({shrunk}) > {qr.HOST_RATE} AS host_bad FROM per, pri),
    d4 AS (SELECT d3.*, NOT base_failed AND NOT (coalesce(host_bad, FALSE) AND (s1 OR s2 OR s3)) AS kept
        FROM d3 LEFT JOIN hv ON d3.source IS NOT DISTINCT FROM hv.host)
    SELECT {columns} FROM d4"""


def chat() -> str:
    said = "'<|im_end|><|im_start|>assistant ok'"
    text = r"regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')"
    role = r"regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')"
    return rf"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', {said}), (-1, 1, 'assistant', {said}))
    SELECT conv_id, count(*)::BIGINT AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        sum(length('<|im_start|>') + length('<|im_end|>') + 2 + length({role}) + length({text}))::BIGINT AS formatted_chars
    FROM r GROUP BY conv_id"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def divergence() -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT lang, source, row, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
g AS (SELECT d.lang, d.source, coalesce(any_value(v), 0) AS v, coalesce(any_value(cn.n), 0) AS n
      FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN v USING (lang)
      LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) cn USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1::HUGEINT + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v)::HUGEINT AS p
      FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
ln AS (SELECT lang, sum(n) AS n FROM g GROUP BY 1),
lp AS (SELECT p.lang, term, 1::HUGEINT + (1000000000::HUGEINT * (sum(p.n) + 1)::HUGEINT) // (any_value(ln.n) + any_value(v.v))::HUGEINT AS q
       FROM p JOIN ln USING (lang) JOIN v USING (lang) GROUP BY 1, 2),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
          UNION ALL SELECT p.lang, p.source, 'term', p.term, (((p - q) * (p - q)) // q)::BIGINT
          FROM p JOIN lp ON lp.lang = p.lang AND lp.term = p.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM every QUALIFY part = 'pair' OR rank <= 200"""


def ranked() -> str:
    def terms(c):
        return rf"regexp_extract_all(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {terms('text')} AS terms FROM documents),
n AS (SELECT row, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
tot AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM n),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY 1, 2),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY 1),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, tot),
q AS (SELECT item, any_value(item_id) AS item_id, term, count(*)::BIGINT AS q
      FROM (SELECT row_number() OVER () AS item, item_id, unnest({terms('text')}) AS term FROM benchmark) GROUP BY item, term),
s AS (SELECT q.item, any_value(q.item_id) AS item_id, n.row, any_value(n.doc_id) AS doc_id,
        sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n ON n.row = tf.row, tot GROUP BY q.item, n.row)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""
