"""SQL for the registered queries, over the same derived tables."""

from __future__ import annotations

from citelink.functions.normalize import BIO_TERMS, CS_TERMS
from citelink.jobs.testbed import SQL, n1, n2
from citelink.operators.decision import NO_HITS, NOTE_LABELS, RULES



def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _join(names: str) -> str:
    return f"array_to_string({names}, '|')"


_WITH = "WITH" + SQL
_RAW_DOI = """CASE work_id % 8 WHEN 0 THEN 'https://doi.org/' || upper(d) WHEN 1 THEN 'DOI: ' || d WHEN 2 THEN ' (' || d || ').' WHEN 3 THEN 'N/A' WHEN 4 THEN replace(d, '/', '/ ')
 WHEN 5 THEN 'http://dx.doi.org/' || d || ';' WHEN 6 THEN '?' END"""
_TOPIC = "['Clinical notes', 'Database systems', 'Old law', 'Deep  Learning'][work_id % 4 + 1]"
_DOMAIN = f"CASE WHEN regexp_matches({n2(f"'On things ' || {_TOPIC}")}, {_q('|'.join(CS_TERMS))}) THEN 'cs' WHEN regexp_matches({n2(f"'On things ' || {_TOPIC}")}, {_q('|'.join(BIO_TERMS))}) THEN 'biomedical' ELSE 'general' END"
_NAME = "lower(authors[1] || ';  Mc.' || authors[2] || CASE WHEN work_id % 2 = 0 THEN ' et al.' ELSE '' END)"

#: Citations as text, as the styles write them.
_LAST = "array_to_string(list_transform(authors, lambda a: substr(a, 4, 20) || ', ' || substr(a, 1, 2)), ', ')"
_BARE = "array_to_string(list_transform(authors, lambda a: substr(a, 4, 20) || ' ' || substr(a, 1, 1)), ', ')"
_FULL = "array_to_string(authors, ', ')"
_END = "coalesce(', doi: ' || doi, '')"
_TEXT = f"""written AS (
    SELECT *, CASE q WHEN 0 THEN {_FULL} || ', “' || t || ',” ' || venue || ', ' || year || {_END} WHEN 1 THEN {_LAST} || ' (' || year || '). ' || t || '. ' || venue || {_END}
        WHEN 2 THEN {_BARE} || '. ' || t || '. ' || venue || '. ' || year || ';15(2):100-110' || {_END} WHEN 3 THEN {_FULL} || ', ' || t || ', ' || venue || ', ' || year || {_END} ELSE lower(t) || ' ' || year END AS original_reference
    FROM citations_text
)"""

#: Merged works, and citations with their lookup keys.
_KEYED = f"""keyed_works AS (
    SELECT *, {n1("doi")} AS norm_doi, {n2("title")} AS norm_title FROM works_raw
), grouped AS (
    SELECT *, CASE WHEN norm_doi <> '' THEN 'doi:' || norm_doi WHEN norm_title <> '' THEN 'title:' || norm_title END AS work_key FROM keyed_works
), merged AS (
    SELECT work_key, arg_min(title, arrival) AS title, arg_min(authors, arrival) AS authors, arg_min(year, arrival) FILTER (year IS NOT NULL) AS year, arg_min(venue, arrival) FILTER (venue IS NOT NULL) AS venue,
           arg_min(doi, arrival) FILTER (doi IS NOT NULL) AS doi, list_sort(list(DISTINCT source)) AS sources, min(arrival) AS arrival
    FROM grouped WHERE work_key IS NOT NULL GROUP BY work_key
), works AS (
    SELECT *, {n1("doi")} AS norm_doi, {n2("title")} AS norm_title FROM merged
), keyed AS (
    SELECT *, norm_doi || '|' || norm_title AS lookup_key FROM (SELECT *, {n1("doi")} AS norm_doi, {n2("title")} AS norm_title FROM citations)
), groups AS (
    SELECT lookup_key, count(*) AS n_citations, arg_min(title, doc_id * 100 + ref_no) AS title, arg_min(year, doc_id * 100 + ref_no) AS year, arg_min(authors, doc_id * 100 + ref_no) AS authors, arg_min(venue, doc_id * 100 + ref_no) AS venue, min(norm_doi) AS norm_doi, min(norm_title) AS norm_title
    FROM keyed GROUP BY lookup_key
)"""
_GROUPS = f"{_WITH}, {_KEYED}"
_STOP = ", ".join(map(_q, ("a", "an", "the", "of", "for", "on", "at", "to", "in", "with", "without", "and", "or", "but", "by", "from", "into", "through")))
_ABOUT = n2("title || ' ' || coalesce(venue, '')")
#: The searches of all stages: (lookup_key, source, place, stage, fields, text).
_SEARCHES = f"""w AS (
    SELECT lookup_key, norm_title, authors, list_filter(string_split(norm_title, ' '), lambda x: x <> '') AS ws,
           CASE WHEN regexp_matches({_ABOUT}, {_q('|'.join(CS_TERMS))}) THEN ['DBLP', 'Semantic Scholar'] WHEN regexp_matches({_ABOUT}, {_q('|'.join(BIO_TERMS))}) THEN ['PubMed', 'Semantic Scholar'] ELSE ['Semantic Scholar'] END AS more
    FROM groups WHERE norm_title <> ''
), t AS (
    SELECT *, list_filter(ws, lambda x: x NOT IN ({_STOP}) AND length(x) > 2) AS short, list_filter(ws, lambda x: x NOT IN ({_STOP}) AND length(x) > 4)[1:8] AS terms FROM w
), texts AS (
    SELECT lookup_key, 2 AS stage, 0 AS j, array_to_string(short, ' ') AS text, TRUE AS two FROM t WHERE array_to_string(short, ' ') NOT IN ('', norm_title)
    UNION ALL SELECT lookup_key, 3, 0, {n2('authors[1]')} || ' ' || array_to_string(ws[1:3], ' '), TRUE FROM t WHERE len(authors) > 0
    UNION ALL SELECT lookup_key, 5, 0, array_to_string(ws[1:len(ws) // 2], ' '), FALSE FROM t WHERE len(ws) >= 6
    UNION ALL SELECT lookup_key, 5, 1, array_to_string(ws[len(ws) // 2 + 1:], ' '), FALSE FROM t WHERE len(ws) >= 6
), combos AS (
    SELECT lookup_key, i, terms[i] || ' ' || terms[i + 1] AS text FROM (SELECT lookup_key, terms, unnest(range(1, least(len(terms) - 1, 4) + 1)) AS i FROM t WHERE len(terms) >= 3)
    UNION ALL SELECT lookup_key, 11, terms[1] || ' ' || terms[len(terms)] FROM t WHERE len(terms) >= 5
    UNION ALL SELECT lookup_key, 12, array_to_string(terms[1:3], ' ') FROM t WHERE len(terms) >= 5
    UNION ALL SELECT lookup_key, 13, array_to_string(terms[len(terms) - 2:], ' ') FROM t WHERE len(terms) >= 5
), once AS (
    SELECT lookup_key, text, row_number() OVER (PARTITION BY lookup_key ORDER BY min(i)) - 1 AS j FROM combos GROUP BY lookup_key, text
), searches AS (
    SELECT lookup_key, 'Crossref' AS source, CAST(j AS INTEGER) AS place, CAST(stage AS INTEGER) AS stage, CASE WHEN stage = 3 THEN 'both' ELSE 'title' END AS fields, text FROM texts
    UNION ALL SELECT lookup_key, 'OpenAlex', CAST(10 + j AS INTEGER), CAST(stage AS INTEGER), CASE WHEN stage = 3 THEN 'both' ELSE 'title' END, text FROM texts WHERE two
    UNION ALL SELECT lookup_key, 'Crossref', 0, 1, CASE WHEN len(ws) > 2 THEN 'phrase' ELSE 'title' END, norm_title FROM t
    UNION ALL SELECT lookup_key, 'Crossref', 1, 1, 'record', norm_title FROM t
    UNION ALL SELECT lookup_key, 'OpenAlex', 10, 1, 'title', norm_title FROM t
    UNION ALL SELECT lookup_key, 'Crossref', CAST(j AS INTEGER), 4, 'title', text FROM once WHERE j < 8
    UNION ALL SELECT lookup_key, more[i], CAST(10 * (i - 1) AS INTEGER), 6, 'title', norm_title FROM (SELECT *, unnest(range(1, len(more) + 1)) AS i FROM t)
)"""

#: The best works of every search: found (lookup_key, source, place, stage, fields, work_key, score, hit_no).
_FOUND = f"""known AS (
    SELECT work_key, unnest(sources) AS source, norm_title, list_filter(string_split(norm_title, ' '), lambda x: x <> '') AS tw, list_filter(string_split({n2("array_to_string(authors, ' ')")}, ' '), lambda x: x <> '') AS nw,
           list_filter(string_split({n2("venue")} || ' ' || {n2("CAST(year AS VARCHAR)")}, ' '), lambda x: x <> '') AS mw FROM works
), texts_of AS (
    SELECT work_key, source, 'title' AS fields, tw AS tokens FROM known
    UNION ALL SELECT work_key, source, 'both', list_concat(tw, nw) FROM known WHERE source IN ('Crossref', 'OpenAlex')
    UNION ALL SELECT work_key, source, 'record', list_concat(list_concat(tw, nw), mw) FROM known WHERE source = 'Crossref'
), sizes AS (
    SELECT source, fields, count(*) AS n, greatest(CAST(1000 * sum(len(tokens)) AS BIGINT) // count(*), 1) AS mean FROM texts_of WHERE len(tokens) > 0 GROUP BY source, fields
), listed AS (
    SELECT work_key, source, fields, size, token, count(*) AS tf FROM (SELECT work_key, source, fields, len(tokens) AS size, unnest(tokens) AS token FROM texts_of) GROUP BY ALL
), rare AS (
    SELECT source, fields, token, min(mean) AS mean, CAST(floor(1000 * ln(1 + min(n) / count(*))) AS BIGINT) AS rarity FROM listed JOIN sizes USING (source, fields) GROUP BY source, fields, token
), impacts AS (
    SELECT work_key, source, fields, token, CAST((rarity * tf * 2200) // (1000 * tf + 300 + (900000 * size) // mean) AS BIGINT) AS impact FROM listed JOIN rare USING (source, fields, token)
), words AS (
    SELECT DISTINCT lookup_key, source, place, stage, fields, text, CASE WHEN fields = 'phrase' THEN 'title' ELSE fields END AS by_fields, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS token FROM searches
), scored AS (
    SELECT lookup_key, q.source, place, stage, q.fields, text, work_key, CAST(sum(impact) AS BIGINT) AS score FROM words q JOIN impacts i ON q.source = i.source AND q.by_fields = i.fields AND q.token = i.token GROUP BY ALL
), allowed AS (
    SELECT s.* FROM scored s JOIN works w USING (work_key) WHERE s.fields <> 'phrase' OR contains(' ' || w.norm_title || ' ', ' ' || s.text || ' ')
), found AS MATERIALIZED (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lookup_key, source, place, stage ORDER BY score DESC, work_key) AS hit_no FROM allowed) WHERE hit_no <= CASE WHEN stage <= 3 THEN 50 WHEN stage <= 5 THEN 30 ELSE 20 END
)"""


def _bucket(buckets: int) -> str:
    return f"CAST('0x' || substr(md5(r.doc_id || ':' || r.ref_no), 1, 8) AS BIGINT) % {buckets}"


def _state(a: str, b: str, values: tuple[str, ...]) -> str:
    return f"[{', '.join(map(_q, values))}][(work_id * {a} + k * {b}) % {len(values)} + 1]"


_EVERY = ("MATCH", "MISMATCH", "MISSING_DATABASE", "MISSING_SUBMITTED", "UNKNOWN")
_FIELD_STATES = {"doi": _state("3", "1", _EVERY), "title": _state("1", "1", ("MATCH", "PARTIAL", "MISMATCH", "MATCH")), "authors": _state("1", "2", ("MATCH", "MATCH", "PARTIAL", "MISMATCH", "MISSING_SUBMITTED")), "year": _state("2", "3", _EVERY), "venue": _state("1", "4", _EVERY)}


def _case(column: int, quote: bool = True) -> str:
    out = []
    for wanted, *result in RULES:
        value = _q(result[column]) if quote else str(result[column]).upper()
        if not wanted:
            return f"CASE {' '.join(out)} ELSE {value} END"
        test = " AND ".join("(" + " OR ".join(f"s_{f} = {_q(state)}" for f in fields) + ")" for fields, state in wanted)
        out.append(f"WHEN {test} THEN {value}")
    return ""


_NOTES = "concat_ws('; ', " + ", ".join(f"CASE s_{f} WHEN 'MISSING_SUBMITTED' THEN '{label} was not provided in the submitted reference' WHEN 'MISSING_DATABASE' THEN '{label} was not provided by the matched database record' END" for f, label in NOTE_LABELS) + ")"
#: Pairs by formula.
_BY_FORMULA = f"""pairs AS (
    SELECT doc_id, ref_no, work_id, k, CAST((work_id * 7 + k * 13) % 101 AS DOUBLE) AS title_score, ((work_id * 11 + k * 29) % 200) / 2.0 AS weighted_score, (work_id + k) % 9 = 0 AS same_doi, {', '.join(f'{sql} AS s_{f}' for f, sql in _FIELD_STATES.items())}
    FROM (SELECT *, unnest(range(0, (work_id // 4) % 5 + 1)) AS k FROM citations WHERE work_id % 5 < 4)
)"""
#: Pairs (doc_id, ref_no, k, title_score, weighted_score, same_doi, s_...) ranked and judged; ties by k.
_JUDGED = f"""marked AS (
    SELECT *, title_score >= 50 OR same_doi AS own, max(CASE WHEN title_score >= 50 OR same_doi THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, ref_no) AS any_own FROM pairs
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, ref_no ORDER BY weighted_score DESC, k) AS rank, count(*) OVER (PARTITION BY doc_id, ref_no) AS n_hits FROM marked WHERE own OR any_own = 0
), spaced AS (
    SELECT *, weighted_score - coalesce(lead(weighted_score) OVER (PARTITION BY doc_id, ref_no ORDER BY rank), 0) AS gap FROM ranked
), judged AS (
    SELECT *, {_case(0)} AS status, {_case(1)} AS reason, {_case(2, False)} AS review, max(CASE WHEN rank = 1 THEN gap END) OVER (PARTITION BY doc_id, ref_no) AS margin FROM spaced
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, ref_no ORDER BY CASE WHEN status = 'VERIFIED' THEN 0 WHEN status = 'UNCERTAIN' AND NOT review THEN 1 WHEN status = 'UNCERTAIN' THEN 2 ELSE 3 END, rank) AS place FROM judged
), decided AS (
    SELECT c.doc_id, c.ref_no, c.title, c.authors, p.rank IS NOT NULL AS found, coalesce(p.status = 'VERIFIED' AND p.n_hits > 1 AND p.margin < 8 AND p.rank = 1, FALSE) AS close, p.*
    EXCLUDE (doc_id, ref_no), {_NOTES} AS notes FROM citations c LEFT JOIN (SELECT * FROM placed WHERE place = 1) p ON p.doc_id = c.doc_id AND p.ref_no = c.ref_no
), final AS (
    SELECT *, CASE WHEN NOT found OR close THEN 'UNCERTAIN' ELSE status END AS d_status,
        CASE WHEN NOT found THEN {_q(NO_HITS)} WHEN close THEN 'The top match looks strong, but a second candidate is nearly as close a match (margin ' || CAST(CAST(round_even(margin, 0) AS INTEGER) AS VARCHAR) || ' points) - too ambiguous to auto-verify. Original assessment: ' || reason ELSE reason END AS d_reason,
        found AND (close OR review) AS d_review, found AND (s_doi = 'MISMATCH' OR s_doi = 'MATCH' AND (s_title = 'MISMATCH' OR s_authors = 'MISMATCH')) AS contradiction
    FROM decided
), routed AS (
    SELECT *, CASE WHEN found AND NOT contradiction AND (d_review OR d_status = 'NOT VERIFIED') THEN 'PENDING_AI' ELSE d_status END AS r_status FROM final
)"""
_DECIDED = f"{_WITH}, {_BY_FORMULA}, {_JUDGED}"
_EXPLAINED = "CASE WHEN r_status <> 'PENDING_AI' THEN d_reason || CASE WHEN notes <> '' THEN ' (' || notes || '.)' ELSE '' END END"

def _share(common: str, a: str, b: str) -> str:
    """The Indel ratio of lengths; 100 for two empty strings is left to the caller."""
    return f"(CAST(100 AS DOUBLE) * (1 - ({a} + {b} - 2 * {common}) / CAST({a} + {b} AS DOUBLE)))"


def _ratio(a: str, b: str, common: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN CAST(100 AS DOUBLE) ELSE {_share(f'coalesce({common}, 0)', f'length({a})', f'length({b})')} END)"


def _sets(a: str, b: str) -> str:
    """Columns shared, ox, oy: sorted words of both strings, of the one only, and of the other only; nx, ny count all words."""
    x, y = (f"list_distinct(list_filter(string_split({c}, ' '), lambda w: w <> ''))" for c in (a, b))

    def line(words: str) -> str:
        return f"array_to_string(list_sort({words}), ' ')"

    return f"""{line(f"list_filter({x}, lambda w: list_contains({y}, w))")} AS shared, {line(f"list_filter({x}, lambda w: NOT list_contains({y}, w))")} AS ox,
        {line(f"list_filter({y}, lambda w: NOT list_contains({x}, w))")} AS oy, len({x}) AS nx, len({y}) AS ny"""


def _set_ratio(common: str) -> str:
    n, x, y = "length(shared)", "length(ox)", "length(oy)"
    gap = "CAST(shared <> '' AS INTEGER)"
    nx, ny = f"({n} + {gap} + {x})", f"({n} + {gap} + {y})"
    apart = f"CAST(100 AS DOUBLE) * (1 - ({x} + {y} - 2 * coalesce({common}, 0)) / CAST({nx} + {ny} AS DOUBLE))"
    return f"""(CASE WHEN nx = 0 OR ny = 0 THEN CAST(0 AS DOUBLE) WHEN shared <> '' AND (ox = '' OR oy = '') THEN CAST(100 AS DOUBLE)
        WHEN shared <> '' THEN greatest({apart}, {_share(n, n, nx)}, {_share(n, n, ny)}) ELSE {apart} END)"""


#: All bits of a block of 60 characters.
_FULL_BLOCK = (1 << 60) - 1


def _lcs(name: str, pairs: str) -> str:
    """Lengths n of the longest common subsequences of string pairs (a, b): a bit for each character of a, in blocks of 60 with a carry, folded over the characters of b."""
    total = "p[1] + (p[1] & p[2]) + done[1]"
    step = f"list_concat([({total}) >> 60], done[2:], [(({total}) & {_FULL_BLOCK}) | (p[1] & xor(p[2], CAST({_FULL_BLOCK} AS BIGINT)))])"
    return f"""{name}_need AS (SELECT DISTINCT a, b FROM ({pairs}) WHERE a <> b AND a <> '' AND b <> ''
    ), {name}_cut AS (
        SELECT a, b, list_transform(range(1, length(a) + 1), lambda i: substr(a, i, 1)) AS x, list_transform(range(1, length(b) + 1), lambda i: substr(b, i, 1)) AS y, range(0, (length(a) + 59) // 60) AS blocks FROM {name}_need
    ), {name}_bits AS MATERIALIZED (
        SELECT *, list_distinct(y) AS cs, list_transform(list_distinct(y), lambda c: list_transform(blocks, lambda k: CAST(list_sum(list_transform(range(0, 60), lambda i: CASE WHEN x[60 * k + i + 1] = c THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT))) AS masks FROM {name}_cut
    ), {name} AS MATERIALIZED (
        SELECT a, b, 60 * len(blocks) - CAST(list_sum(list_transform(
            list_reduce(list_concat([list_transform(blocks, lambda k: CAST({_FULL_BLOCK} AS BIGINT))], list_transform(y, lambda c: masks[list_position(cs, c)])),
                lambda v, m: list_reduce(list_concat([[CAST(0 AS BIGINT)]], list_transform(blocks, lambda k: [v[k + 1], m[k + 1]])), lambda done, p: {step})[2:]),
            lambda v: bit_count(v))) AS INTEGER) AS n FROM {name}_bits
    )"""


def _authors(lists: str, named: str = "author") -> str:
    """Similarity of lists of three authors: own names take the best name left, in order; ``lists`` selects authors and w_authors."""
    form = "trim(regexp_replace(regexp_replace(lower({}), '[.,;:]', ' ', 'g'), ' +', ' ', 'g'))"
    hidden = "list_transform({}, lambda v, k: CASE WHEN k IN ({}) THEN -1 ELSE v END)"
    last = "string_split({}, ' ')[-1]"
    first = "array_to_string(list_transform(string_split({}, ' '), lambda w: w[1]), '')"
    return f"""{named}_lists AS (SELECT DISTINCT authors, w_authors FROM ({lists})
    ), {named}_cells AS (SELECT authors, w_authors, i, j, {form.format('authors[i]')} AS x, {form.format('w_authors[j]')} AS y FROM {named}_lists, range(1, 4) AS p(i), range(1, 4) AS q(j)
    ), {named}_names AS (SELECT x, y, {_sets('x', 'y')}, {last.format('x')} AS lx, {last.format('y')} AS ly FROM (SELECT DISTINCT x, y FROM {named}_cells)
    ), {_lcs(f'{named}_lcs', f'SELECT ox AS a, oy AS b FROM {named}_names UNION ALL SELECT lx, ly FROM {named}_names')}, {named}_parts AS (
        SELECT x, y, {_set_ratio('s.n')} AS words, {_ratio('lx', 'ly', 'l.n')} AS last, CASE WHEN {first.format('x')} = {first.format('y')} THEN 90 ELSE 0 END AS initials
        FROM {named}_names LEFT JOIN {named}_lcs s ON s.a = ox AND s.b = oy LEFT JOIN {named}_lcs l ON l.a = lx AND l.b = ly
    ), {named}_scores AS (SELECT x, y, CASE WHEN x = y THEN CAST(100 AS DOUBLE) WHEN last >= 90 AND words >= 60 THEN greatest(words, 90) ELSE greatest(words, initials, last * CAST(0.6 AS DOUBLE)) END AS s FROM {named}_parts
    ), {named}_rows AS (SELECT authors, w_authors, i, list(s ORDER BY j) AS s FROM {named}_cells JOIN {named}_scores USING (x, y) GROUP BY authors, w_authors, i
    ), {named}_sides AS (SELECT authors, w_authors, any_value(s) FILTER (i = 1) AS s1, any_value(s) FILTER (i = 2) AS s2, any_value(s) FILTER (i = 3) AS s3 FROM {named}_rows GROUP BY authors, w_authors
    ), {named}_one AS (SELECT *, list_position(s1, list_max(s1)) AS j1 FROM {named}_sides
    ), {named}_two AS (SELECT *, {hidden.format('s2', 'j1')} AS t2 FROM {named}_one
    ), {named}_three AS (SELECT *, list_position(t2, list_max(t2)) AS j2 FROM {named}_two
    ), {named}_similarity AS (SELECT authors, w_authors, round(least(100, (list_max(s1) + list_max(t2) + list_max({hidden.format('s3', 'j1, j2')})) / 3 + 5), 2) AS score FROM {named}_three)"""


_MEASURED = f"""{_WITH}, m AS (
    SELECT c.work_id, {n2('c.title')} AS a, {n2('b.title')} AS b, c.authors, b.authors AS w_authors, c.title AS own FROM citations c JOIN base b USING (work_id)
), w AS (
    SELECT *, {_sets('a', 'b')}, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb, replace(a, ' ', '') AS ca, replace(b, ' ', '') AS cb FROM m
), {_lcs('lcs', 'SELECT a, b FROM w UNION ALL SELECT sa, sb FROM w UNION ALL SELECT ca, cb FROM w UNION ALL SELECT ox, oy FROM w')},
{_authors('SELECT authors, w_authors FROM m')}, r AS (
    SELECT work_id, own, w.a, w.b, {_ratio('w.a', 'w.b', 'l1.n')} AS ratio, {_ratio('sa', 'sb', 'l2.n')} AS sorted_ratio, {_ratio('ca', 'cb', 'l3.n')} AS tight, {_set_ratio('l4.n')} AS set_ratio, score
    FROM w LEFT JOIN lcs l1 ON l1.a = w.a AND l1.b = w.b LEFT JOIN lcs l2 ON l2.a = sa AND l2.b = sb LEFT JOIN lcs l3 ON l3.a = ca AND l3.b = cb LEFT JOIN lcs l4 ON l4.a = ox AND l4.b = oy
    JOIN author_similarity USING (authors, w_authors)
)"""

#: Pools: every citation's works up to the stage of its first strong match; pool (lookup_key, work_key, stage, arrival).
_POOL = f"""{_GROUPS}, {_SEARCHES}, {_FOUND}, by_doi AS (
    SELECT lookup_key, work_key FROM groups g JOIN works w ON g.norm_doi = w.norm_doi AND g.norm_doi <> '' WHERE list_has_any(w.sources, ['Crossref', 'OpenAlex', 'Semantic Scholar'])
), hits AS MATERIALIZED (
    SELECT lookup_key, work_key, min(stage) AS stage, min(arrival) AS arrival
    FROM (SELECT lookup_key, work_key, 1 AS stage, 0 AS arrival FROM groups g JOIN works w ON g.norm_title = w.norm_title AND g.norm_title <> '' UNION ALL SELECT lookup_key, work_key, stage, 1000000 * stage + 1000 * place + hit_no FROM found)
    WHERE lookup_key NOT IN (SELECT lookup_key FROM by_doi) GROUP BY ALL
), pairs_met AS MATERIALIZED (
    SELECT h.*, g.norm_title AS a, w.norm_title AS b, g.authors, w.authors AS w_authors, g.norm_doi <> '' AND g.norm_doi = w.norm_doi AS same FROM hits h JOIN groups g USING (lookup_key) JOIN works w USING (work_key)
), titles_met AS (
    SELECT a, b, {_sets('a', 'b')}, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb FROM (SELECT DISTINCT a, b FROM pairs_met)
), titles_wide AS (
    SELECT *, {_set_ratio('least(length(ox), length(oy))')} AS set_most, CAST(200 AS DOUBLE) * least(length(a), length(b)) / (length(a) + length(b)) AS size_most FROM titles_met
), titles_near AS MATERIALIZED (
    SELECT * FROM titles_wide WHERE set_most >= 95 OR (size_most >= 95 AND 200 * list_sum(list_transform(list_distinct(string_split(a, '')), lambda c: least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))))) >= 95 * (length(a) + length(b)))
), near_pairs AS MATERIALIZED (SELECT * FROM pairs_met JOIN titles_near USING (a, b)
), {_authors('SELECT authors, w_authors FROM near_pairs')}, by_authors AS MATERIALIZED (
    SELECT * FROM near_pairs JOIN author_similarity USING (authors, w_authors) WHERE score >= 90
), set_open AS MATERIALIZED (SELECT DISTINCT a, b, sa, sb, shared, ox, oy, nx, ny FROM by_authors WHERE a <> b AND {_set_ratio('0')} < 95
), {_lcs('lcs', 'SELECT a, b FROM set_open UNION ALL SELECT sa, sb FROM set_open UNION ALL SELECT ox, oy FROM set_open')}, titles_same AS MATERIALIZED (
    SELECT a, b FROM by_authors WHERE a = b OR {_set_ratio('0')} >= 95
    UNION SELECT o.a, o.b FROM set_open o LEFT JOIN lcs l1 ON l1.a = o.a AND l1.b = o.b LEFT JOIN lcs l2 ON l2.a = sa AND l2.b = sb LEFT JOIN lcs l4 ON l4.a = ox AND l4.b = oy
    WHERE greatest({_ratio('o.a', 'o.b', 'l1.n')}, {_ratio('sa', 'sb', 'l2.n')}, {_set_ratio('l4.n')}) >= 95
), strong AS (
    SELECT lookup_key, stage FROM by_authors JOIN titles_same USING (a, b) UNION ALL SELECT lookup_key, stage FROM pairs_met WHERE same
), stops AS (SELECT lookup_key, min(stage) AS stop FROM strong GROUP BY lookup_key
), pool AS (
    SELECT lookup_key, work_key, 0 AS stage, 0 AS arrival FROM by_doi UNION ALL SELECT lookup_key, work_key, stage, arrival FROM hits LEFT JOIN stops USING (lookup_key) WHERE stop IS NULL OR stage <= stop
)"""

_VENUES = f"""{_GROUPS}, f AS (
    SELECT k.norm_doi AS a, w.norm_doi AS b, k.year AS y, w.year AS z, coalesce(k.venue, '') AS v, coalesce(w.venue, '') AS u, k.authors, w.authors AS w_authors FROM keyed k JOIN works w ON k.norm_title = w.norm_title AND w.norm_title <> ''
), venues AS (SELECT v, u, {_sets(n2('v'), n2('u'))} FROM (SELECT DISTINCT v, u FROM f)
), {_lcs('lcs', 'SELECT ox AS a, oy AS b FROM venues')}, {_authors('SELECT authors, w_authors FROM f')},
venue_scores AS (SELECT v, u, {_set_ratio('l.n')} AS s FROM venues LEFT JOIN lcs l ON l.a = ox AND l.b = oy)"""


def _rounded(x: str, by: int = 10) -> str:
    """A number of 0 or more rounded half to even at its decimal form, to a part of ``by``."""
    scaled = f"(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 17)) * {by})"
    down, rest = f"floor({scaled})", f"({scaled} - floor({scaled}))"
    return f"(CAST({down} + CASE WHEN {rest} > 0.5 OR ({rest} = 0.5 AND CAST({down} AS BIGINT) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / {by})"


_GENERAL = ", ".join(map(_q, ("machine learning", "deep learning", "artificial intelligence", "data mining", "computer vision", "natural language processing")))
#: Every citation's works of its DOI, or else of its title and the first two of each search of stage 1: pool (lookup_key, work_key, arrival).
_BY_TITLE = f"""{_GROUPS}, {_SEARCHES}, {_FOUND}, by_doi AS (
    SELECT lookup_key, work_key FROM groups g JOIN works w ON g.norm_doi = w.norm_doi AND g.norm_doi <> '' WHERE list_has_any(w.sources, ['Crossref', 'OpenAlex', 'Semantic Scholar'])
), pool AS MATERIALIZED (
    SELECT lookup_key, work_key, 0 AS arrival FROM by_doi
    UNION ALL SELECT lookup_key, work_key, min(arrival) FROM (
        SELECT lookup_key, work_key, 0 AS arrival FROM groups g JOIN works w ON g.norm_title = w.norm_title AND g.norm_title <> '' UNION ALL SELECT lookup_key, work_key, 1000000 + 1000 * place + hit_no FROM found WHERE stage = 1 AND hit_no <= 2
    ) WHERE lookup_key NOT IN (SELECT lookup_key FROM by_doi) GROUP BY ALL
)"""
#: Pairs of every citation with the works of its pool, measured, ranked, judged and routed. Names of helpers differ from the pool's own.
_VERIFIED = f"""m AS MATERIALIZED (
    SELECT k.doc_id, k.ref_no, k.authors, w.authors AS w_authors, k.norm_title AS a, w.norm_title AS b, k.norm_doi AS da, w.norm_doi AS db, k.year AS y, w.year AS z, coalesce(k.venue, '') AS v, coalesce(w.venue, '') AS u, w.title AS matched,
           row_number() OVER (PARTITION BY k.doc_id, k.ref_no ORDER BY pool.arrival, work_key) AS k FROM keyed k JOIN pool USING (lookup_key) JOIN works w USING (work_key)
), titles AS MATERIALIZED (
    SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb, replace(a, ' ', '') AS ca, replace(b, ' ', '') AS cb FROM (SELECT DISTINCT a, b FROM m)
), {_lcs('title_lcs', 'SELECT sa AS a, sb AS b FROM titles UNION ALL SELECT ca, cb FROM titles')}, title_scores AS (
    SELECT t.a, t.b, CASE WHEN t.a = '' OR t.b = '' THEN CAST(0 AS DOUBLE) ELSE greatest({_ratio('sa', 'sb', 'l2.n')}, {_ratio('ca', 'cb', 'l3.n')}) END AS t_score,
           CASE WHEN length(t.a) <= length(t.b) THEN length(t.a) >= 8 AND starts_with(t.b, t.a) AND t.a NOT IN ({_GENERAL}) ELSE length(t.b) >= 8 AND starts_with(t.a, t.b) AND t.b NOT IN ({_GENERAL}) END AS short
    FROM titles t LEFT JOIN title_lcs l2 ON l2.a = sa AND l2.b = sb LEFT JOIN title_lcs l3 ON l3.a = ca AND l3.b = cb
), venues AS (SELECT v, u, {_sets(n2('v'), n2('u'))} FROM (SELECT DISTINCT v, u FROM m)
), {_lcs('venue_lcs', 'SELECT ox AS a, oy AS b FROM venues')}, {_authors('SELECT authors, w_authors FROM m', 'pair')},
venue_scores AS (SELECT v, u, {_set_ratio('l.n')} AS s FROM venues LEFT JOIN venue_lcs l ON l.a = ox AND l.b = oy
), states AS (
    SELECT doc_id, ref_no, k, matched, t_score, coalesce(score, 0) AS score, short, da <> '' AND da = db AS same_doi,
        CASE WHEN da = '' AND db = '' THEN 'UNKNOWN' WHEN da = '' THEN 'MISSING_SUBMITTED' WHEN db = '' THEN 'MISSING_DATABASE' WHEN replace(da, '-', '') = replace(db, '-', '') THEN 'MATCH' ELSE 'MISMATCH' END AS s_doi,
        CASE WHEN t_score >= 90 OR short THEN 'MATCH' WHEN t_score < 50 THEN 'MISMATCH' ELSE 'PARTIAL' END AS s_title, CASE WHEN len(authors) = 0 THEN 'MISSING_SUBMITTED' WHEN score >= 75 THEN 'MATCH' WHEN score < 40 THEN 'MISMATCH' ELSE 'PARTIAL' END AS s_authors,
        CASE WHEN z IS NULL THEN 'MISSING_DATABASE' WHEN y = z THEN 'MATCH' WHEN abs(y - z) = 1 THEN 'PARTIAL' ELSE 'MISMATCH' END AS s_year,
        CASE WHEN v = '' AND u = '' THEN 'UNKNOWN' WHEN v = '' THEN 'MISSING_SUBMITTED' WHEN u = '' THEN 'MISSING_DATABASE' WHEN s >= 70 THEN 'MATCH' WHEN s < 40 THEN 'MISMATCH' ELSE 'PARTIAL' END AS s_venue
    FROM m JOIN title_scores USING (a, b) LEFT JOIN pair_similarity USING (authors, w_authors) JOIN venue_scores USING (v, u)
), weighed AS (
    SELECT *, CAST(0.5 AS DOUBLE) * t_score + CAST(0.35 AS DOUBLE) * score + CAST(0.15 AS DOUBLE) * CASE s_year WHEN 'MATCH' THEN 100 WHEN 'PARTIAL' THEN 75 WHEN 'MISMATCH' THEN 0 ELSE 50 END AS plain FROM states
), pairs AS MATERIALIZED (
    SELECT *, {_rounded('t_score')} AS title_score, {_rounded('CASE WHEN same_doi THEN 100 WHEN short THEN greatest(plain, 90) ELSE plain END')} AS weighted_score FROM weighed
), {_JUDGED}"""

#: Citations read back from their text; what no style fits has the text for its title and no authors.
_PARSED = f"""parsed AS (
    SELECT doc_id, ref_no, CASE WHEN q < 4 THEN t ELSE substr(lower(t) || ' ' || year, 1, 300) END AS title,
        CASE q WHEN 0 THEN authors WHEN 1 THEN list_transform(authors, lambda a: substr(a, 4, 20) || ', ' || substr(a, 1, 2)) WHEN 2 THEN list_transform(authors, lambda a: substr(a, 4, 20) || ' ' || substr(a, 1, 1)) WHEN 3 THEN authors ELSE [] END AS authors, year,
        CASE WHEN q IN (0, 3) THEN venue || CASE WHEN doi IS NOT NULL THEN ', ' || year ELSE '' END WHEN q = 1 THEN venue WHEN q = 2 THEN venue || '. ' || year || ';15(2):100-110' END AS venue, CASE WHEN q < 4 THEN doi END AS doi,
        ['quoted', 'apa_or_vancouver', 'vancouver_plain', 'fallback', NULL][q + 1] AS parse_style FROM arrived
)"""


def _of_text(arrived: str) -> str:
    """The whole verification of citations as text; ``arrived`` selects rows of ``written``."""
    job = f"{_KEYED}{_POOL.removeprefix(_GROUPS)}, {_VERIFIED}".replace("FROM citations)", "FROM parsed)").replace("FROM citations c ", "FROM parsed c ")
    return f"{_WITH}, {_TEXT}, arrived AS ({arrived}), {_PARSED}, {job}"


ORACLES: dict[str, str] = {
    "normalize_doi": f"{_WITH} SELECT work_id, {n1('raw')} AS doi FROM (SELECT work_id, {_RAW_DOI} AS raw FROM (SELECT *, coalesce(doi, '10.1/x') AS d FROM base))",
    "normalize_text": f"{_WITH} SELECT work_id, {n2("'<scp>Pre- view</scp> of: ' || title")} AS norm FROM base",
    "normalize_author": rf"{_WITH} SELECT work_id, trim(regexp_replace(regexp_replace(regexp_replace({_NAME}, '\bet\s+al\.?\b', '', 'g'), '[.,;:]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM base",
    "domains": f"{_WITH} SELECT work_id, domain, CASE domain WHEN 'cs' THEN 'DBLP|Semantic Scholar' WHEN 'biomedical' THEN 'PubMed|Semantic Scholar' ELSE 'Semantic Scholar' END AS extra FROM (SELECT work_id, {_DOMAIN} AS domain FROM base)",
    "read_sources": f"{_WITH} SELECT work_id, arrival, title, {_join('authors')} AS authors, doi, year, venue, source FROM works_raw",
    "quarantine": f"""{_WITH} SELECT source, CASE work_id % 25 WHEN 3 THEN 'not a record of this source' WHEN 5 THEN 'no record' WHEN 7 THEN 'no record' ELSE 'read' END AS reason, count(*) AS n FROM works_raw GROUP BY ALL""",
    "read_citations": f"""{_WITH} SELECT CASE WHEN work_id % 20 <> 9 THEN doc_id END AS doc_id, CASE WHEN work_id % 20 <> 9 THEN ref_no END AS ref_no, CASE WHEN work_id % 20 = 9 THEN '[' || work_id ELSE 'citation' END AS original_reference,
        CASE WHEN work_id % 20 <> 9 THEN title END AS title, CASE WHEN work_id % 20 <> 9 THEN {_join('authors')} END AS authors, CASE WHEN work_id % 20 NOT IN (4, 9) THEN year END AS year, CASE WHEN work_id % 20 <> 9 THEN venue END AS venue,
        CASE WHEN work_id % 20 <> 9 THEN doi END AS doi, CASE work_id % 20 WHEN 9 THEN 'the record is not a citation' WHEN 4 THEN 'the year is not a number: in press' END AS error FROM citations""",
    "number_batches": f"""{_WITH} SELECT batch, count(*) AS n, min(doc_id * 100 + ref_no) AS first FROM (SELECT *, (row_number() OVER (ORDER BY doc_id, ref_no) - 1) // 8 AS batch FROM citations) GROUP BY batch""",
    "reading_order": """
        WITH blocks AS (SELECT doc_id, n // 4 AS page, (n // 2) % 2 AS side, n % 2 AS row, n, lines[n + 1] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents))
        SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY page, side, row, n)) AS text_md5 FROM blocks GROUP BY doc_id""",
    "extract_references": f"""{_WITH}, {_TEXT} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ref_no) AS INTEGER) AS ref_no, original_reference
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM written WHERE length(original_reference) > 25) WHERE n >= 2""",
    "parse_citations": f"""{_WITH} SELECT doc_id, ref_no, CASE WHEN q < 4 THEN t END AS title,
        CASE q WHEN 0 THEN {_join('authors')} WHEN 1 THEN {_join("list_transform(authors, lambda a: substr(a, 4, 20) || ', ' || substr(a, 1, 2))")} WHEN 2 THEN {_join("list_transform(authors, lambda a: substr(a, 4, 20) || ' ' || substr(a, 1, 1))")} WHEN 3 THEN {_join('authors')} END AS authors,
        CASE WHEN q < 4 THEN year END AS year, CASE WHEN q < 4 THEN doi END AS doi, ['quoted', 'apa_or_vancouver', 'vancouver_plain', 'fallback', NULL][q + 1] AS parse_style,
        CASE WHEN q IN (0, 3) THEN venue || CASE WHEN doi IS NOT NULL THEN ', ' || year ELSE '' END WHEN q = 1 THEN venue WHEN q = 2 THEN venue || '. ' || year || ';15(2):100-110' END AS venue FROM citations_text""",
    "merge_external_parses": f"""{_WITH} SELECT doc_id, ref_no, CASE WHEN q < 4 OR work_id % 2 = 0 THEN t ELSE substr(lower(t) || ' ' || year, 1, 300) END AS title, CASE WHEN q < 4 OR work_id % 2 = 0 THEN 3 ELSE 0 END AS n_authors, year, CASE WHEN q < 4 OR work_id % 2 = 0 THEN doi END AS doi
        FROM citations_text""",
    "parse_coverage": f"{_WITH} SELECT count(*) FILTER (q < 4) AS parsed, count(*) AS total FROM citations_text",
    "works_merged": f"{_GROUPS} SELECT work_key, title, {_join('authors')} AS authors, year, venue, doi, {_join('sources')} AS sources, arrival FROM works",
    "works_updated": f"{_GROUPS} SELECT work_key, title, {_join('authors')} AS authors, year, venue, doi, {_join('sources')} AS sources, arrival FROM works",
    "lookup_groups": f"{_GROUPS} SELECT lookup_key, n_citations, title, year FROM groups",
    "doi_candidates": f"{_GROUPS} SELECT lookup_key, work_key FROM groups g JOIN works w ON g.norm_doi = w.norm_doi AND g.norm_doi <> '' WHERE list_has_any(w.sources, ['Crossref', 'OpenAlex', 'Semantic Scholar'])",
    "title_candidates": f"{_GROUPS} SELECT lookup_key, work_key FROM groups g JOIN works w ON g.norm_title = w.norm_title AND g.norm_title <> ''",
    "stage_queries": f"{_GROUPS}, {_SEARCHES} SELECT lookup_key, source, place, stage, text FROM searches",
    "search_topk": f"""{_GROUPS}, {_SEARCHES}, {_FOUND}
        SELECT lookup_key, source, place, stage, work_key, score, hit_no FROM found""",
    "candidate_counts": f"{_POOL} SELECT doc_id, ref_no, count(*) AS n_candidates FROM keyed JOIN pool USING (lookup_key) GROUP BY doc_id, ref_no",
    "staged_candidates": f"{_POOL} SELECT stage, count(*) AS n FROM (SELECT doc_id, ref_no, min(stage) AS stage FROM keyed JOIN pool USING (lookup_key) GROUP BY doc_id, ref_no) GROUP BY stage",
    "doi_year_states": f"""{_GROUPS} SELECT k.doc_id, k.ref_no, w.work_key,
        CASE WHEN k.norm_doi = '' AND w.norm_doi = '' THEN 'UNKNOWN' WHEN k.norm_doi = '' THEN 'MISSING_SUBMITTED' WHEN w.norm_doi = '' THEN 'MISSING_DATABASE' WHEN replace(k.norm_doi, '-', '') = replace(w.norm_doi, '-', '') THEN 'MATCH' ELSE 'MISMATCH' END AS doi_state,
        CASE WHEN w.year IS NULL THEN 'MISSING_DATABASE' WHEN abs(k.year - w.year) = 0 THEN 'MATCH' WHEN abs(k.year - w.year) = 1 THEN 'PARTIAL' ELSE 'MISMATCH' END AS year_state, length(k.norm_title) >= 8 AS short
        FROM keyed k JOIN works w ON k.norm_title = w.norm_title AND w.norm_title <> ''""",
    "title_measures": f"""{_MEASURED} SELECT work_id, ratio, sorted_ratio, set_ratio, CASE WHEN own <> '' THEN greatest(sorted_ratio, tight) ELSE 0 END AS similarity,
        CASE WHEN a = b AND a <> '' THEN 100 WHEN a <> '' AND b <> '' THEN greatest(set_ratio, ratio, sorted_ratio) ELSE 0 END AS identity, score AS authors FROM r""",
    "field_states": f"""{_VENUES} SELECT
        CASE WHEN a = '' AND b = '' THEN 'UNKNOWN' WHEN a = '' THEN 'MISSING_SUBMITTED' WHEN b = '' THEN 'MISSING_DATABASE' WHEN replace(a, '-', '') = replace(b, '-', '') THEN 'MATCH' ELSE 'MISMATCH' END AS doi,
        'MATCH' AS title, CASE WHEN score >= 75 THEN 'MATCH' WHEN score < 40 THEN 'MISMATCH' ELSE 'PARTIAL' END AS authors,
        CASE WHEN z IS NULL THEN 'MISSING_DATABASE' WHEN y = z THEN 'MATCH' WHEN abs(y - z) = 1 THEN 'PARTIAL' ELSE 'MISMATCH' END AS year,
        CASE WHEN v = '' AND u = '' THEN 'UNKNOWN' WHEN v = '' THEN 'MISSING_SUBMITTED' WHEN u = '' THEN 'MISSING_DATABASE' WHEN s >= 70 THEN 'MATCH' WHEN s < 40 THEN 'MISMATCH' ELSE 'PARTIAL' END AS venue, count(*) AS n
        FROM f JOIN author_similarity USING (authors, w_authors) JOIN venue_scores USING (v, u) GROUP BY ALL""",
    "flagship": f"""{_GROUPS}, by_doi AS (
            SELECT lookup_key, work_key FROM groups g JOIN works w ON g.norm_doi = w.norm_doi AND g.norm_doi <> '' WHERE list_has_any(w.sources, ['Crossref', 'OpenAlex', 'Semantic Scholar'])
        ), hits AS MATERIALIZED (
            SELECT * FROM by_doi UNION ALL SELECT lookup_key, work_key FROM groups g JOIN works w ON g.norm_title = w.norm_title AND g.norm_title <> '' WHERE lookup_key NOT IN (SELECT lookup_key FROM by_doi)
        ), pairs AS (SELECT k.norm_doi AS a, w.norm_doi AS b, k.year AS y, w.year AS z FROM keyed k JOIN hits USING (lookup_key) JOIN works w USING (work_key))
        SELECT CASE WHEN a = '' AND b = '' THEN 'UNKNOWN' WHEN a = '' THEN 'MISSING_SUBMITTED' WHEN b = '' THEN 'MISSING_DATABASE' WHEN replace(a, '-', '') = replace(b, '-', '') THEN 'MATCH' ELSE 'MISMATCH' END AS doi_state,
            CASE WHEN z IS NULL THEN 'MISSING_DATABASE' WHEN y = z THEN 'MATCH' WHEN abs(y - z) = 1 THEN 'PARTIAL' ELSE 'MISMATCH' END AS year_state, count(*) AS n FROM pairs GROUP BY 1, 2""",
    "verify_documents": f"""{_of_text("""SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ref_no) AS INTEGER) AS ref_no)
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM written WHERE length(original_reference) > 25) WHERE n >= 2""")} SELECT r.doc_id, r.ref_no, parse_style, r_status AS status, matched AS matched_title
        FROM routed r JOIN parsed p ON p.doc_id = r.doc_id AND p.ref_no = r.ref_no""",
    "verify_stream": f"""{_of_text("SELECT * FROM written")} SELECT r.doc_id, r.ref_no, r_status AS status, matched AS matched_title FROM routed r""",
    "verify_titles": f"""{_BY_TITLE}, {_VERIFIED} SELECT r.doc_id, r.ref_no, r_status AS status, {_EXPLAINED} AS explanation, coalesce(n_hits, 0) AS n_hits, matched AS matched_title, weighted_score AS score,
        s_doi || '|' || s_title || '|' || s_authors || '|' || s_year || '|' || s_venue AS states FROM routed r""",
    "verify": f"""{_POOL}, {_VERIFIED} SELECT r.doc_id, r.ref_no, r_status AS status, CASE WHEN r_status <> 'PENDING_AI' THEN 'deterministic rules' END AS source, matched AS matched_title, weighted_score AS score FROM routed r""",
    "rank_pairs": f"{_DECIDED} SELECT doc_id, ref_no, k AS arrival, rank, weighted_score, CASE WHEN rank = 1 THEN gap END AS margin, n_hits FROM spaced",
    "top_hits": f"""{_DECIDED} SELECT doc_id, ref_no, string_agg('T' || k, '|' ORDER BY place) AS titles
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ref_no ORDER BY weighted_score DESC, k) AS place FROM pairs) WHERE place <= 3 GROUP BY doc_id, ref_no""",
    "decide": f"{_DECIDED} SELECT doc_id, ref_no, d_status AS deterministic_status, d_reason AS deterministic_reason, d_review AS needs_review, 'T' || k AS chosen, coalesce(n_hits, 0) AS n_hits, notes FROM routed",
    "route": f"{_DECIDED} SELECT doc_id, ref_no, r_status AS status, {_EXPLAINED} AS explanation, CASE WHEN r_status <> 'PENDING_AI' THEN 'deterministic rules' END AS source, CASE WHEN found THEN 'DBLP|PubMed' ELSE '' END AS agreeing FROM routed",
    "review_queue": f"""{_DECIDED}, open AS (
            SELECT r.doc_id, r.ref_no, c.title, c.authors, c.year, c.venue, c.doi, CAST({_bucket(64)} AS INTEGER) AS bucket FROM routed r JOIN citations c ON c.doc_id = r.doc_id AND c.ref_no = r.ref_no WHERE r_status = 'PENDING_AI'
        ), hits AS MATERIALIZED (
            SELECT doc_id, ref_no, string_agg(rank || '/T' || k || '/A. Abor/2000/10.1/z/V/DBLP/' || CAST(title_score AS INTEGER) || '/50/50/' || CAST(round(weighted_score * 10) AS INTEGER) || '/PubMed+DBLP+DBLP', ';' ORDER BY rank) AS candidates FROM judged WHERE rank <= 5 GROUP BY ALL
        )
        SELECT o.doc_id, o.ref_no, bucket, CAST((row_number() OVER (PARTITION BY bucket ORDER BY o.doc_id, o.ref_no) - 1) // 6 AS BIGINT) AS batch, o.ref_no AS reference_id, 'citation' AS original_reference, title, {_join('authors')} AS authors, year, venue, doi, candidates
        FROM open o JOIN hits h ON h.doc_id = o.doc_id AND h.ref_no = o.ref_no""",
    "apply_verdicts": f"""{_DECIDED}, v AS (
            SELECT *, (doc_id * 10 + ref_no) % 6 AS m FROM routed
        ), p AS (
            SELECT v.doc_id, v.ref_no, v.r_status, v.d_status, v.k AS best, v.m, j.k AS picked, j.status AS rule, j.s_doi AS pd, j.s_title AS pt, j.s_authors AS pa,
                   CASE WHEN v.m = 4 THEN v.d_status WHEN v.m = 2 THEN 'NOT VERIFIED' WHEN v.m = 3 THEN 'UNCERTAIN' ELSE 'VERIFIED' END AS verdict, CASE v.m WHEN 0 THEN 1 WHEN 1 THEN 9 WHEN 3 THEN 2 END AS idx
            FROM v LEFT JOIN judged j ON j.doc_id = v.doc_id AND j.ref_no = v.ref_no AND v.r_status = 'PENDING_AI' AND j.rank = CASE v.m WHEN 0 THEN 1 WHEN 3 THEN 2 END AND j.rank <= 5
        ), g AS (
            SELECT *, coalesce(verdict = 'VERIFIED' AND picked IS NOT NULL AND (pd = 'MISMATCH' OR pd = 'MATCH' AND (pt = 'MISMATCH' OR pa = 'MISMATCH')), FALSE) AS contradicted FROM p
        ), h AS (SELECT *, verdict = 'VERIFIED' AND picked IS NOT NULL AND NOT contradicted AND rule = 'NOT VERIFIED' AS rejected FROM g)
        SELECT doc_id, ref_no, CASE WHEN r_status <> 'PENDING_AI' THEN r_status WHEN contradicted OR coalesce(rejected, FALSE) THEN 'NOT VERIFIED' ELSE verdict END AS status,
            CASE WHEN r_status <> 'PENDING_AI' THEN 'deterministic rules' WHEN contradicted OR coalesce(rejected, FALSE) THEN 'deterministic safety gate' ELSE 'AI verification' END AS source,
            'T' || CASE WHEN r_status = 'PENDING_AI' AND picked IS NOT NULL AND NOT contradicted THEN picked ELSE best END AS chosen,
            CASE WHEN r_status = 'PENDING_AI' THEN CASE WHEN m = 4 THEN 'ai_missing_verdict' ELSE '' END END AS conflicts, CASE WHEN r_status = 'PENDING_AI' THEN CAST(idx AS INTEGER) END AS ai_selected_candidate_index FROM h""",
    "report": f"""{_DECIDED} SELECT r.doc_id, r.ref_no, r_status AS status, CASE WHEN r_status IN ('UNCERTAIN', 'NOT VERIFIED') THEN 'Yes' ELSE 'No' END AS manual_check_needed, coalesce({_EXPLAINED}, '') AS explanation, 'citation' AS original_reference,
        c.title AS submitted_title, array_to_string(c.authors, ', ') AS submitted_authors, c.year AS submitted_year, c.doi AS submitted_doi, 'T' || k AS matched_title, CASE WHEN found THEN 'A. Abor' ELSE '' END AS matched_authors,
        CAST(CASE WHEN found THEN 2000 END AS INTEGER) AS matched_year, CASE WHEN found THEN '10.1/z' END AS matched_doi, CASE WHEN found THEN 'DBLP, PubMed' ELSE '' END AS sources_agreeing,
        CASE WHEN r_status <> 'PENDING_AI' THEN 'deterministic rules' ELSE '' END AS verification_source FROM routed r JOIN citations c ON c.doc_id = r.doc_id AND c.ref_no = r.ref_no""",
    "text_report": f"""{_DECIDED}, blocks AS (
            SELECT r.doc_id, r.ref_no, 'REFERENCE ' || r.ref_no || chr(10) || repeat('-', 70) || chr(10) || 'Original Reference:' || chr(10) || 'citation' || chr(10) || chr(10) || 'STATUS: '
                || CASE r_status WHEN 'VERIFIED' THEN '✓' WHEN 'UNCERTAIN' THEN '⚠' WHEN 'NOT VERIFIED' THEN '✗' ELSE '?' END || ' ' || r_status || CASE WHEN r_status IN ('UNCERTAIN', 'NOT VERIFIED') THEN chr(10) || '⚠️ MANUAL CHECK NEEDED - see reason and evidence below' ELSE '' END
                || chr(10) || 'Source: ' || CASE WHEN r_status <> 'PENDING_AI' THEN 'deterministic rules' ELSE 'N/A' END || chr(10) || chr(10) || 'Reason: ' || coalesce({_EXPLAINED}, 'N/A') || chr(10) || chr(10) || 'SUBMITTED METADATA' || chr(10) || 'Title:   ' || c.title
                || chr(10) || 'Authors: ' || array_to_string(c.authors, ', ') || chr(10) || 'Year:    ' || c.year || chr(10) || 'DOI:     ' || coalesce(c.doi, 'N/A')
                || CASE WHEN found THEN chr(10) || chr(10) || 'BEST MATCH' || chr(10) || 'Title:   T' || k || chr(10) || 'Authors: A. Abor' || chr(10) || 'Year:    2000' || chr(10) || 'DOI:     10.1/z' || chr(10) || 'Source:  DBLP' || chr(10) || chr(10) || 'Sources agreeing: DBLP, PubMed (2)' ELSE '' END
                || chr(10) || repeat('-', 70) AS block FROM routed r JOIN citations c ON c.doc_id = r.doc_id AND c.ref_no = r.ref_no
        ) SELECT doc_id, ref_no, CAST(len(string_split(block, chr(10))) AS BIGINT) AS n_lines, md5(block) AS block_md5 FROM blocks""",
    "assign_batches": f"""{_WITH} SELECT bucket, batch, count(*) AS n FROM (SELECT bucket, (row_number() OVER (PARTITION BY bucket ORDER BY doc_id, ref_no) - 1) // 8 AS batch FROM (SELECT doc_id, ref_no, CAST({_bucket(16)} AS INTEGER) AS bucket FROM citations r)) GROUP BY ALL""",
    "status_summary": f"{_DECIDED} SELECT count(*) AS total, count(*) FILTER (r_status = 'VERIFIED') AS verified, count(*) FILTER (r_status = 'UNCERTAIN') AS uncertain, count(*) FILTER (r_status = 'NOT VERIFIED') AS not_verified, 0 AS errors FROM routed",
    "usage_summary": """
        WITH calls AS (SELECT event_type AS chain, 'provider' || user_id % 2 AS provider, CAST(floor(abs(value)) AS BIGINT) AS p, event_id % 100 AS c FROM events)
        SELECT chain, provider, count(*) AS n_calls, CAST(sum(p) AS BIGINT) AS input_tokens, CAST(sum(c) AS BIGINT) AS output_tokens, CAST(sum(p + c) AS BIGINT) AS total_tokens FROM calls GROUP BY GROUPING SETS ((chain), (provider), ())""",
}
