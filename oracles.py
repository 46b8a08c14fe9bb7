"""DuckDB statements that compute each registered query in another way.

Every piece is one common table expression; a statement takes the pieces that it
needs, in this order. Hierarchies are recursive, counts are plain joins, and search
is brute force: every query term against every posting.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

import fixture_tables as fx
from waymark.functions import markup

_TOKENS = "regexp_extract_all(replace(replace(lower({0}), 'ё', 'е'), '@', ''), '[0-9a-z_а-я]+')"
# Words joined by single hyphens count once more as a whole.
_WHOLES = _TOKENS.replace("]+'", "]+(?:-[0-9a-z_а-я]+)+'")


def _fill(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


_PIECES = {
    "addrobj": _fill(fx.ADDROBJ),
    "socrbase": _fill(fx.SOCRBASE),
    "cur": "SELECT * FROM addrobj WHERE actstatus AND livestatus AND nextid IS NULL",
    "id_requests": _fill(fx.ID_REQUESTS),
    "version_requests": _fill(fx.VERSION_REQUESTS),
    "deletes": _fill(fx.DELETES),
    "resolved": """
      SELECT r.request_id, a.aoid, a.aoguid,
             row_number() OVER (PARTITION BY r.request_id
               ORDER BY CASE WHEN a.aoid = r.uuid THEN 0 ELSE 1 END, a.id) AS rn
      FROM id_requests r LEFT JOIN (
        SELECT aoid AS k, id, aoid, aoguid FROM addrobj
        UNION SELECT aoguid, id, aoid, aoguid FROM cur) a ON a.k = r.uuid""",
    "chain": """
      SELECT r.request_id, 0 AS depth, a.aoid, a.aoguid, a.shortname, a.formalname, a.aolevel,
             a.regioncode, a.parentguid
      FROM resolved r JOIN addrobj a ON a.aoid = r.aoid WHERE r.rn = 1
      UNION ALL
      SELECT c.request_id, c.depth + 1, a.aoid, a.aoguid, a.shortname, a.formalname, a.aolevel,
             a.regioncode, a.parentguid
      FROM chain c JOIN cur a ON a.aoguid = c.parentguid""",
    "elements": """
      SELECT c.request_id, c.depth, c.aoid, c.aoguid, c.shortname, c.formalname, c.aolevel,
             c.regioncode, s.socrname, 'ok' AS status
      FROM chain c LEFT JOIN socrbase s ON s.scname = c.shortname AND s.level = c.aolevel
      UNION ALL
      SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not_found'
      FROM resolved WHERE rn = 1 AND aoid IS NULL""",
    # The names from an object upwards, as a list; and those from the top downwards.
    "ascent": """
      SELECT v.request_id, o.parentguid AS above, [concat_ws(' ', o.shortname, o.formalname)] AS names
      FROM version_requests v, addrobj o WHERE o.aoid = v.uuid
      UNION
      SELECT x.request_id, o.parentguid,
             list_append(x.names, concat_ws(' ', o.shortname, o.formalname))
      FROM ascent x, cur o WHERE o.aoguid = x.above""",
    "climb": """
      SELECT request_id, above AS parentguid, array_to_string(list_reverse(names), ', ') AS fullname
      FROM ascent""",
    "descent": """
      SELECT id, aoguid AS below, [shortname] AS shorts, [formalname] AS formals
      FROM cur WHERE aolevel = 1
      UNION
      SELECT o.id, o.aoguid, list_append(x.shorts, o.shortname), list_append(x.formals, o.formalname)
      FROM descent x, cur o WHERE o.parentguid = x.below""",
    "path": """
      SELECT id, aoid, aoguid, aolevel,
             array_to_string([z[1] || ' ' || z[2] for z in list_zip(shorts, formals)], ', ') AS fullname,
             array_to_string(shorts, ' ') AS sname
      FROM descent JOIN cur USING (id)""",
    "paths": """
      SELECT id, aoid, fullname, sname,
             length(fullname) - length(replace(fullname, ' ', '')) AS wordcount
      FROM path WHERE aolevel NOT IN (1, 3)""",
    "tokens": f"""
      SELECT unnest({_TOKENS.format('t')} || {_WHOLES.format('t')}) AS word FROM (
        SELECT fullname AS t FROM paths UNION ALL SELECT sname FROM paths
        UNION ALL SELECT text FROM documents) x""",
    "dictionary": """
      SELECT word, count(*) AS frequency FROM tokens
      GROUP BY word ORDER BY frequency DESC, word LIMIT 200000""",
    "raw_addrobj": _fill(fx.RAW_ADDROBJ),
    "faults": """
      SELECT *, row_number() OVER () AS nr, lower(trim(AOID)) AS aoid_key, list_filter([
        CASE WHEN AOID IS NULL THEN 'aoid: missing' END,
        CASE WHEN length(SHORTNAME) > 10 THEN 'shortname: too long' END,
        CASE WHEN length(FORMALNAME) > 120 THEN 'formalname: too long' END,
        CASE WHEN AOLEVEL IS NOT NULL AND TRY_CAST(AOLEVEL AS SMALLINT) IS NULL THEN 'aolevel: not smallint' END,
        CASE WHEN ACTSTATUS NOT IN ('0', '1') THEN 'actstatus: not boolean' END],
        LAMBDA x: x IS NOT NULL) AS found
      FROM raw_addrobj""",
    "faults_repeated": """
      SELECT AOID, found, CASE WHEN len(found) = 0 AND aoid_key IS NOT NULL
        AND count(*) FILTER (len(found) = 0) OVER (PARTITION BY aoid_key) > 1
        THEN ['aoid: repeated'] ELSE found END AS reasons FROM faults""",
    "page_pieces": f"""
      SELECT page_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS piece FROM (
        SELECT page_id, regexp_extract_all(html, '{markup.pattern("").replace("'", "''")}') AS p FROM pages)""",
    "page_named": "SELECT * FROM (VALUES " + ", ".join(
        "('&{};', '{}')".format(k, chr(n).replace("'", "''")) for k, n in name2codepoint.items()
    ) + ") AS v(name, sign)",
    "page_plain": r"""
      SELECT page_id, string_agg(CASE
        WHEN sign IS NOT NULL THEN sign
        WHEN regexp_full_match(piece, '&#[0-9]+;') THEN chr(piece[3:-2]::INT)
        WHEN piece[1] <> '<' OR piece = '<' THEN piece
        WHEN regexp_matches(piece, '^(?i:</?(""" + "|".join(markup.INLINE) + r"""))([^a-zA-Z0-9]|$)') THEN ''
        ELSE ' ' END, '' ORDER BY i) AS t
      FROM page_pieces LEFT JOIN page_named ON name = piece GROUP BY page_id""",
    "request_lines": """
      SELECT concat_ws(':', doc_id, unnest(range(len(l)))) AS request_id, unnest(l) AS text
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)""",
    "threshold": _fill(fx.FREQ_THRESHOLD),
    "prefixes": """
      SELECT substr(word, 1, k) AS p, count(*) AS n
      FROM dictionary, unnest(range(1, length(word) + 1)) AS t(k) GROUP BY 1""",
    "find_requests": _fill(fx.FIND_REQUESTS),
    "all_words": _fill(fx.WORD_REQUESTS),
    "word_requests": "SELECT request_id, pos, word, word AS bare FROM all_words",
    "find_split": r"""
      SELECT request_id, unnest(generate_series(0, len(a) - 1)) AS pos, unnest(a) AS bare
      FROM (SELECT request_id, string_split_regex(lower(text), '[ ,:.#$]+') AS a
            FROM find_requests
            WHERE regexp_full_match(text, '[0-9A-zА-яЁё, .\-/]{3,}')) x""",
    "find_words": """
      SELECT request_id, pos, trim(translate(bare, '@#', ''), '-') AS word, bare
      FROM find_split WHERE trim(translate(bare, '@#', ''), '-') <> ''""",
}


def _ranks(words: str) -> str:
    """Counts of each word over the un-merged words of a request."""
    return f"""
      SELECT l.request_id, l.word, f.freq, l.cnt_like, f.cnt_exact, s.cnt_socr, s.scname,
             h.cnt_socr_like,
             CASE WHEN cnt_like >= 5 THEN 'x' ELSE CAST(cnt_like AS VARCHAR) END
             || CASE WHEN cnt_exact > 1 THEN 'x' ELSE CAST(cnt_exact AS VARCHAR) END
             || CASE WHEN cnt_socr > 1 THEN 'x' ELSE CAST(cnt_socr AS VARCHAR) END
             || CASE WHEN cnt_socr_like > 1 THEN 'x' ELSE CAST(cnt_socr_like AS VARCHAR) END AS code
      FROM (SELECT request_id, word, CAST(sum(coalesce(n, 0)) AS BIGINT) AS cnt_like
            FROM {words} LEFT JOIN prefixes ON p = word GROUP BY ALL) l
      JOIN (SELECT w.request_id, w.word, count(d.word) AS cnt_exact, max(frequency) AS freq
            FROM {words} w LEFT JOIN dictionary d ON d.word = w.word GROUP BY ALL) f
        ON f.request_id = l.request_id AND f.word = l.word
      JOIN (SELECT w.request_id, w.word, count(b.scname) AS cnt_socr, max(b.scname) AS scname
            FROM {words} w LEFT JOIN socrbase b ON lower(b.socrname) = lower(w.bare)
            GROUP BY ALL) s
        ON s.request_id = l.request_id AND s.word = l.word
      JOIN (SELECT w.request_id, w.word, count(b.scname) AS cnt_socr_like
            FROM {words} w LEFT JOIN socrbase b ON lower(b.scname) = lower(w.bare)
            GROUP BY ALL) h
        ON h.request_id = l.request_id AND h.word = l.word"""


def _types(ranks: str) -> str:
    """Match types as a list of conditions on the single characters."""
    return f"""
      SELECT *, as_is0 OR (star0 AND length(word) < 3) AS as_is,
             star0 AND NOT both_star AND length(word) >= 3 AS last_star
      FROM (SELECT r.*, code = '0000' AS many,
                   (a = '1' AND b = '0') OR (a = 'x' AND b = '0') AS few,
                   (a = '1' AND b = '0' AND c = '0') OR (a = 'x' AND c = '0') AS star0,
                   code = 'x000' AS both_star, b = '1' OR d IN ('1', 'x') AS as_is0,
                   c IN ('1', 'x') AND d = '0' AS add_socr,
                   c = '0' AND d IN ('1', 'x') AS is_socr
            FROM (SELECT *, code[1] AS a, code[2] AS b, code[3] AS c, code[4] AS d
                  FROM {ranks}) r) t"""


def _suggestions(words: str) -> str:
    """All dictionary words that share a trigram with a word, ranked."""
    return f"""
      SELECT q AS word, pos, s AS suggestion, rnk AS rank, frequency, rnk / top AS precision
      FROM (
        SELECT *, count(*) FILTER (rnk = top) OVER (PARTITION BY q) AS perfect
        FROM (
          SELECT *, row_number() OVER (PARTITION BY q ORDER BY rnk DESC, frequency DESC, s) AS pos,
                 max(rnk) OVER (PARTITION BY q) AS top
          FROM (
            SELECT q.w AS q, t.word AS s, t.frequency,
                   count(*) + 2 - abs(length(t.word) - length(q.w)) AS rnk
            FROM (SELECT DISTINCT word AS w, substr('__' || word || '__', k, 3) AS g
                  FROM {words}, unnest(range(1, length(word) + 3)) AS u(k)) q
            JOIN (SELECT word, frequency, substr('__' || word || '__', k, 3) AS g
                  FROM dictionary, unnest(range(1, length(word) + 3)) AS u(k)) t ON t.g = q.g
            WHERE abs(length(t.word) - length(q.w)) <= 2
            GROUP BY q.w, t.word, t.frequency) p) r
        WHERE pos <= 10 AND top - rnk < 2) z
      WHERE (perfect < 2 OR rnk = top) AND pos <= 6"""


def _terms(mode: str, types: str, words: str, suggestions: str | None) -> str:
    """Terms that stand for each word: (request_id, pos, part, k, term, boost)."""
    rest = f"""
      SELECT w.request_id, w.pos, 'f' AS part, 10 AS k, t.word || '*' AS term, 0.9 AS boost
      FROM {words} w JOIN {types} t ON t.request_id = w.request_id AND t.word = w.word
      WHERE (last_star OR both_star) AND coalesce(freq, 0) <= (SELECT n FROM threshold)
      UNION ALL
      SELECT w.request_id, w.pos, CASE WHEN is_socr THEN 's' ELSE 'f' END, 11,
             CASE WHEN is_socr THEN w.bare ELSE w.word END, 1.0
      FROM {words} w JOIN {types} t ON t.request_id = w.request_id AND t.word = w.word
      WHERE as_is
      UNION ALL
      SELECT w.request_id, w.pos, 's', 12, scname, 1.0
      FROM {words} w JOIN {types} t ON t.request_id = w.request_id AND t.word = w.word
      WHERE add_socr AND scname <> ''"""
    if suggestions is None:
        return rest
    return f"""
      SELECT request_id, pos, CASE WHEN hot THEN 's' ELSE 'f' END AS part, k, suggestion AS term,
             CASE WHEN hot THEN 1.0 WHEN others = 1 THEN 0.9 ELSE round(precision - 0.2, 2) END
               AS boost
      FROM (
        SELECT w.request_id, w.pos, s.pos AS k, s.suggestion, s.precision,
               s.frequency > (SELECT n FROM threshold) AS hot,
               count(*) FILTER (s.frequency <= (SELECT n FROM threshold)) OVER z AS others,
               max(CASE WHEN s.frequency > (SELECT n FROM threshold) THEN s.frequency ELSE 1 END)
                 OVER z AS first_s,
               max(CASE WHEN s.frequency <= (SELECT n FROM threshold) THEN s.frequency ELSE 0 END)
                 OVER z AS second_s
        FROM {words} w JOIN {types} t ON t.request_id = w.request_id AND t.word = w.word
             JOIN {suggestions} s ON s.word = w.word
        WHERE many OR few
        WINDOW z AS (PARTITION BY w.request_id, w.pos)) x
      WHERE hot OR second_s / first_s >= 0.001
      UNION ALL {rest}"""


def _variations(words: str, terms: str) -> str:
    return f"""
      SELECT w.request_id, w.pos, w.word,
        coalesce(string_agg(term || ':' || CAST(CAST(round(boost * 100) AS INT) AS VARCHAR), '|'
                 ORDER BY k) FILTER (part = 'f'), '') AS full_terms,
        coalesce(string_agg(term || ':' || CAST(CAST(round(boost * 100) AS INT) AS VARCHAR), '|'
                 ORDER BY k) FILTER (part = 's'), '') AS abbr_terms,
        coalesce(string_agg(term, ', ' ORDER BY k) FILTER (part = 'f'), '') AS f_words,
        coalesce(string_agg(term, ', ' ORDER BY k) FILTER (part = 's'), '') AS s_words
      FROM {words} w LEFT JOIN {terms} t ON t.request_id = w.request_id AND t.pos = w.pos
      GROUP BY w.request_id, w.pos, w.word"""


def _kept(variations: str, strong: bool) -> str:
    """Distinct variations of each request that is not refused."""
    refuse = f"""WHERE request_id NOT IN (SELECT request_id FROM {variations}
                 WHERE full_terms = '' AND abbr_terms = '')""" if strong else ""
    return f"""
      SELECT request_id, pos, full_terms, abbr_terms,
             bool_or(abbr_terms <> '') OVER (PARTITION BY request_id) AS has_short
      FROM (SELECT *, row_number() OVER (PARTITION BY request_id, f_words, s_words
                                         ORDER BY pos) AS rn
            FROM {variations} {refuse}) x WHERE rn = 1"""


def _options(kept: str, strong: bool) -> str:
    ops = "('and', 0)" if strong else "('and', 0), ('maybe', 1)"
    return f"""
      SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY o, NOT short) - 1 AS INT)
                AS cort
      FROM (
        SELECT *, row_number() OVER (
                 PARTITION BY request_id, CASE WHEN n_groups > 1 THEN op END, groups, sname
                 ORDER BY o, NOT short) AS rn
        FROM (
          SELECT request_id, op, o, short,
                 count(*) FILTER (full_terms <> '' AND (NOT short OR abbr_terms = '')) AS n_groups,
                 coalesce(string_agg(full_terms, ' & ' ORDER BY pos)
                   FILTER (full_terms <> '' AND (NOT short OR abbr_terms = '')), '') AS groups,
                 coalesce(string_agg(abbr_terms, '|' ORDER BY pos)
                   FILTER (short AND abbr_terms <> ''), '') AS sname
          FROM {kept}, (VALUES {ops}) AS p(op, o), (VALUES (true), (false)) AS q(short)
          WHERE NOT short OR has_short
          GROUP BY request_id, op, o, short) x) y
      WHERE rn = 1"""


def _query_terms(kept: str, options: str, terms: str) -> str:
    """Terms of every variant: (request_id, cort, field, g, required, term, boost)."""
    return f"""
      SELECT o.request_id, o.cort, 'f' AS field, v.g, o.op = 'and' OR v.g = 1 AS required,
             t.term, t.boost
      FROM {options} o JOIN (
             SELECT request_id, pos, false AS short,
                    row_number() OVER (PARTITION BY request_id ORDER BY pos) AS g
             FROM {kept} WHERE full_terms <> ''
             UNION ALL
             SELECT request_id, pos, true,
                    row_number() OVER (PARTITION BY request_id ORDER BY pos)
             FROM {kept} WHERE full_terms <> '' AND abbr_terms = '') v
             ON v.request_id = o.request_id AND v.short = o.short
           JOIN {terms} t ON t.request_id = v.request_id AND t.pos = v.pos AND t.part = 'f'
      UNION ALL
      SELECT o.request_id, o.cort, 's', v.g, true, v.term, 1.0
      FROM {options} o JOIN (
             SELECT k.request_id, t.term,
                    row_number() OVER (PARTITION BY k.request_id ORDER BY k.pos, t.k) AS g
             FROM {kept} k
             JOIN {terms} t ON t.request_id = k.request_id AND t.pos = k.pos AND t.part = 's') v
             ON v.request_id = o.request_id AND o.short"""


def _weighted(query_terms: str) -> str:
    """Query terms as index terms, prefixes spelt out, with their weights."""
    return f"""
      SELECT q.request_id, q.cort, q.field, q.g, q.required, x.term,
             max(q.boost) * max(ln((n - df + 1) / df)) / max(2 * ln(n + 1.0)) AS weight
      FROM (SELECT request_id, cort, field, g, required, boost, term AS t, false AS star
            FROM {query_terms} WHERE term NOT LIKE '%*'
            UNION ALL
            SELECT request_id, cort, field, g, required, boost, left(term, length(term) - 1), true
            FROM {query_terms} WHERE term LIKE '%*') q
      JOIN (SELECT field, term, term AS t, false AS star, df FROM terms
            UNION ALL
            SELECT 'f', term, prefix, true, df FROM expansions) x
        ON x.field = q.field AND x.t = replace(replace(lower(q.t), 'ё', 'е'), '@', '')
           AND x.star = q.star,
           (SELECT count(*) AS n FROM paths) c
      GROUP BY q.request_id, q.cort, q.field, q.g, q.required, x.term"""


_RUNS = """
      SELECT request_id, cort, doc_id, sum(run) AS fields
      FROM (SELECT request_id, cort, doc_id, field, max(run) AS run
            FROM (SELECT request_id, cort, doc_id, field, count(*) AS run
                  FROM (SELECT *, g - row_number() OVER (
                               PARTITION BY request_id, cort, doc_id, field, pos - g ORDER BY g)
                               AS island
                        FROM (SELECT DISTINCT m.request_id, m.cort, m.doc_id, m.field, m.g, p.pos
                              FROM {matched} m
                              JOIN postings p ON p.doc_id = m.doc_id AND p.field = m.field
                                             AND p.term = m.term) d) e
                  GROUP BY request_id, cort, doc_id, field, pos - g, island) f
            GROUP BY request_id, cort, doc_id, field) h
      GROUP BY request_id, cort, doc_id"""


def _hits(options: str, weighted: str, query_terms: str, words: str, strong: bool) -> str:
    """The ten best documents of every variant, from all documents."""
    matched = f"""(SELECT w.request_id, w.cort, w.field, w.g, w.required, w.term, w.weight,
                          p.doc_id, p.n
                   FROM {weighted} w JOIN counted p ON p.field = w.field AND p.term = w.term)"""
    good = f"""
      SELECT request_id, cort, doc_id, 0.5 + sum(weight * (n / (n + 1.2))) AS relevance,
             count(DISTINCT field) AS fields
      FROM {matched} m GROUP BY request_id, cort, doc_id
      HAVING count(DISTINCT CASE WHEN required THEN field || g END) = (
        SELECT count(DISTINCT field || g) FROM {query_terms} q
        WHERE q.request_id = m.request_id AND q.cort = m.cort AND q.required)"""
    fields = "good.fields"
    runs = ""
    if strong:
        runs = f"""JOIN ({_RUNS.format(matched=matched)}) r
                   ON r.request_id = good.request_id AND r.cort = good.cort
                      AND r.doc_id = good.doc_id"""
        fields = "r.fields"
    return f"""
      SELECT request_id, cort, pos, doc_id, aoid, fullname, krank
      FROM (SELECT *, row_number() OVER (PARTITION BY request_id, cort
                                         ORDER BY krank DESC, doc_id, fullname) AS pos
            FROM (SELECT good.request_id, good.cort, good.doc_id, d.aoid, d.fullname,
                         CAST(1000 * {fields} + floor(round(1000 * relevance, 6))
                           - 4 * abs(d.wordcount - c.n_words) AS BIGINT) AS krank
                  FROM ({good}) good {runs}
                  JOIN paths d ON d.id = good.doc_id
                  JOIN (SELECT request_id, count(*) AS n_words FROM {words} GROUP BY 1) c
                    ON c.request_id = good.request_id) x) y
      WHERE pos <= 10"""


def _merged(hits: str) -> str:
    return f"""
      SELECT request_id, pos, cort, fullname AS text, krank AS ratio, aoid
      FROM (SELECT *, row_number() OVER (PARTITION BY request_id
                                         ORDER BY cort, krank DESC, doc_id, fullname) AS pos
            FROM (SELECT * EXCLUDE (pos), row_number() OVER (
                           PARTITION BY request_id, aoid
                           ORDER BY cort, krank DESC, doc_id, fullname) AS nth
                  FROM {hits}) x
            WHERE nth = 1) y
      WHERE pos <= 10"""


_PIECES.update(
    {
        "postings": f"""
      SELECT term, doc_id, field, pos
      FROM (SELECT id AS doc_id, 'f' AS field, unnest(t) AS term,
                   unnest(generate_series(0, len(t) - 1)) AS pos
            FROM (SELECT id, {_TOKENS.format('fullname')} AS t FROM paths) a
            UNION ALL
            SELECT id, 's', unnest(t), unnest(generate_series(0, len(t) - 1))
            FROM (SELECT id, {_TOKENS.format('sname')} AS t FROM paths) b) x""",
        "counted": "SELECT field, term, doc_id, count(*) AS n FROM postings GROUP BY ALL",
        "terms": "SELECT field, term, count(*) AS df FROM counted GROUP BY ALL",
        "expansions": """
      SELECT prefix, pos, term, df
      FROM (SELECT substr(term, 1, k) AS prefix, term, df,
                   row_number() OVER (PARTITION BY substr(term, 1, k) ORDER BY df DESC, term) AS pos
            FROM terms, unnest(range(3, length(term) + 1)) AS u(k) WHERE field = 'f') x
      WHERE pos <= 32""",
        "ranks": _ranks("word_requests"),
        "types": _types("ranks"),
        "bench_words": f"""
      SELECT DISTINCT substr(word, 1, 1) || substr(word, 3) AS word
      FROM (SELECT unnest({_TOKENS.format('text')}) AS word FROM benchmark) x
      WHERE length(word) > 4""",
        "suggestions": _suggestions("bench_words"),
        "find_ranks": _ranks("find_words"),
        "find_types": _types("find_ranks"),
        "find_unknown": "SELECT DISTINCT word FROM find_types WHERE many OR few",
        "find_suggestions": _suggestions("find_unknown"),
    }
)
for _mode, _sugg in (("soft", "find_suggestions"), ("strong", None)):
    _is_strong = _mode == "strong"
    _PIECES.update(
        {
            f"terms_{_mode}": _terms(_mode, "find_types", "find_words", _sugg),
            f"variations_{_mode}": _variations("find_words", f"terms_{_mode}"),
            f"kept_{_mode}": _kept(f"variations_{_mode}", _is_strong),
            f"options_{_mode}": _options(f"kept_{_mode}", _is_strong),
            f"query_terms_{_mode}": _query_terms(
                f"kept_{_mode}", f"options_{_mode}", f"terms_{_mode}"
            ),
            f"weighted_{_mode}": _weighted(f"query_terms_{_mode}"),
            f"hits_{_mode}": _hits(
                f"options_{_mode}", f"weighted_{_mode}", f"query_terms_{_mode}",
                "find_words", _is_strong,
            ),
            f"merged_{_mode}": _merged(f"hits_{_mode}"),
        }
    )


def statement(final: str) -> str:
    """`final` with the pieces that it needs, directly or not."""
    needed: set[str] = set()
    waiting = [final]
    while waiting:
        text = waiting.pop()
        for name in re.findall(r"\b[a-z_]+\b", text):
            if name in _PIECES and name not in needed:
                needed.add(name)
                waiting.append(_PIECES[name])
    inline = {"chain", "ascent", "descent"}  # recursive
    pieces = [
        f"{name} AS {'' if name in inline else 'MATERIALIZED '}({text})"
        for name, text in _PIECES.items()
        if name in needed
    ]
    return f"WITH RECURSIVE {', '.join(pieces)}\n{final}" if pieces else final


FINAL = {
    "paths": "SELECT id, aoid, fullname, sname, wordcount FROM paths",
    "normalize": """SELECT request_id, aoid,
        CASE WHEN aoid IS NULL THEN 'not_found' ELSE 'ok' END AS status
        FROM resolved WHERE rn = 1""",
    "to_guid": """SELECT request_id, aoguid,
        CASE WHEN aoid IS NULL THEN 'not_found' WHEN aoguid IS NULL THEN 'invalid'
             ELSE 'ok' END AS status
        FROM resolved WHERE rn = 1""",
    "expand": "SELECT * FROM elements",
    "expand_chains": """SELECT request_id, status, count(aoid) AS n_elements,
        coalesce(string_agg(shortname || ' ' || formalname || ' (' || coalesce(socrname, '?') || ')',
                 ' > ' ORDER BY aolevel, depth DESC), '') AS chain
        FROM elements GROUP BY request_id, status""",
    "full_text": """SELECT r.request_id, t.fullname,
        CASE WHEN t.request_id IS NULL THEN 'not_found' WHEN t.fullname IS NULL THEN 'invalid'
             ELSE 'ok' END AS status
        FROM version_requests r LEFT JOIN (
          SELECT request_id, min(fullname) AS fullname FROM climb WHERE parentguid IS NULL
          GROUP BY request_id) t ON t.request_id = r.request_id""",
    "apply_deletes": """SELECT * FROM addrobj
        WHERE NOT EXISTS (SELECT 1 FROM deletes d WHERE d.aoid = addrobj.aoid)""",
    "unique_violations": """SELECT aoguid, count(*) AS n FROM addrobj WHERE aoguid IS NOT NULL
        GROUP BY aoguid HAVING count(*) > 1""",
    "width_report": """
        SELECT 'shortname' AS name, 10 AS width, max(length(shortname)) AS longest,
               count(*) FILTER (length(shortname) > 10) AS too_long,
               count(*) FILTER (shortname IS NULL) AS nulls FROM addrobj
        UNION ALL
        SELECT 'formalname', 120, max(length(formalname)),
               count(*) FILTER (length(formalname) > 120),
               count(*) FILTER (formalname IS NULL) FROM addrobj
        UNION ALL
        SELECT 'aoid', NULL, max(length(aoid)), 0, count(*) FILTER (aoid IS NULL) FROM addrobj""",
    "tsv_roundtrip": """SELECT lower(aoid) AS aoid, lower(aoguid) AS aoguid, shortname, formalname,
        aolevel, lower(parentguid) AS parentguid, actstatus, livestatus, lower(nextid) AS nextid,
        regioncode FROM addrobj""",
    "xml_roundtrip": """SELECT lower(aoid) AS aoid, lower(aoguid) AS aoguid, shortname, formalname,
        aolevel, lower(parentguid) AS parentguid, actstatus, livestatus, lower(nextid) AS nextid,
        regioncode FROM addrobj""",
    "xml_single_file": """SELECT lower(aoid) AS aoid, lower(aoguid) AS aoguid, shortname,
        formalname, aolevel, lower(parentguid) AS parentguid, actstatus, livestatus,
        lower(nextid) AS nextid, regioncode FROM addrobj""",
    "numbered_parts": """SELECT aoid, (row_number() OVER (ORDER BY id) - 1) // 1000 AS part
        FROM addrobj""",
    "refused_rows": """SELECT AOID, array_to_string(reasons, '; ') AS reasons FROM faults_repeated
        WHERE len(reasons) > 0""",
    "table_versions": """SELECT 1 AS version, id, aoid FROM addrobj WHERE aolevel < 6
        UNION ALL SELECT 2, id, aoid FROM addrobj
        UNION ALL SELECT 3, id, aoid FROM addrobj WHERE aolevel <> 6""",
    "dictionary_half": """SELECT word, frequency FROM (
          SELECT word, frequency, row_number() OVER (ORDER BY frequency DESC, word) AS n,
                 count(*) OVER () AS total
          FROM (SELECT word, count(*) AS frequency FROM tokens GROUP BY word))
        WHERE n <= total // 2""",
    "dictionary_roundtrip": """SELECT word, (SELECT string_agg(substr('__' || word || '__', k, 3), ' ' ORDER BY k)
                 FROM unnest(range(1, length(word) + 3)) AS u(k)) AS trigramm, frequency
        FROM dictionary WHERE length(word) <= 43""",
    "page_words": f"""SELECT word, count(*) AS frequency FROM (
        SELECT unnest({_TOKENS.format('t')} || {_WHOLES.format('t')}) AS word FROM page_plain)
        GROUP BY word""",
    "request_status": r"""SELECT request_id, CASE
        WHEN text IS NOT NULL AND regexp_full_match(text, '[0-9A-zА-яЁё, .\-/]{3,}\n?')
          AND len([w FOR w IN string_split_regex(lower(text), '[ ,:.#$]+')
                   IF trim(translate(w, '@#', ''), '-') <> '']) > 0 THEN 'ok'
        ELSE 'bad_data' END AS status FROM request_lines""",
    "dictionary": "SELECT word, frequency FROM dictionary",
    "trigrams": """SELECT word, (SELECT string_agg(substr('__' || word || '__', k, 3), ' ' ORDER BY k)
                 FROM unnest(range(1, length(word) + 3)) AS u(k)) AS trigramm,
        frequency, length(word) AS len FROM dictionary""",
    "find_words": "SELECT request_id, pos, word, bare FROM find_words",
    "rank_words": "SELECT * FROM ranks",
    "rank_codes": "SELECT code, count(*) AS n FROM ranks GROUP BY code",
    "match_types": """SELECT request_id, word, code, many AS many_sugg, few AS some_sugg, last_star,
        both_star, as_is, add_socr, is_socr FROM types""",
    "suggest": """SELECT word, pos, suggestion, rank, frequency, round(precision, 9) AS precision
        FROM suggestions""",
    "variations_soft": "SELECT request_id, pos, word, full_terms, abbr_terms FROM variations_soft",
    "variations_strong":
        "SELECT request_id, pos, word, full_terms, abbr_terms FROM variations_strong",
    "postings": "SELECT term, doc_id, field, pos FROM postings",
    "index_terms": "SELECT field, term, df FROM terms",
    "prefix_expand": "SELECT prefix, pos, term, df FROM expansions",
    "query_plans": """SELECT request_id, cort, op, groups, sname FROM options_soft""",
    "query_plans_strong": """SELECT request_id, cort, op, groups, sname FROM options_strong""",
    "match_all": """SELECT h.request_id, h.cort, h.pos, h.doc_id, h.aoid, h.fullname, h.krank
        FROM hits_soft h JOIN options_soft o ON o.request_id = h.request_id AND o.cort = h.cort
        WHERE o.op = 'and'""",
    "match_maybe": """SELECT h.request_id, h.cort, h.pos, h.doc_id, h.aoid, h.fullname, h.krank
        FROM hits_soft h JOIN options_soft o ON o.request_id = h.request_id AND o.cort = h.cort
        WHERE o.op = 'maybe'""",
    "find_soft": """SELECT r.request_id, m.pos, m.cort, m.text, m.ratio, m.aoid,
        CASE WHEN r.request_id NOT IN (SELECT request_id FROM find_words) THEN 'bad_data'
             ELSE 'ok' END AS status
        FROM find_requests r LEFT JOIN merged_soft m ON m.request_id = r.request_id""",
    "find_strong": """SELECT r.request_id, m.pos, m.cort, m.text, m.ratio, m.aoid,
        CASE WHEN r.request_id NOT IN (SELECT request_id FROM find_words) THEN 'bad_data'
             WHEN m.aoid IS NULL THEN 'not_found' ELSE 'ok' END AS status
        FROM find_requests r LEFT JOIN (
          SELECT * FROM merged_strong a WHERE pos = 1 AND NOT EXISTS (
            SELECT 1 FROM merged_strong b
            WHERE b.request_id = a.request_id AND b.pos = 2 AND b.ratio = a.ratio)) m
          ON m.request_id = r.request_id""",
}


FINAL["find_saved"] = FINAL["find_soft"]


def oracle_sql() -> dict[str, str]:
    return {name: statement(final) for name, final in FINAL.items()}
