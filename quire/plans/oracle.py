"""The queries of this library in SQL for another engine (RE2 patterns, no look-around), as common table expressions."""

from __future__ import annotations

from quire.functions import fixed
from quire.plans.fixtures import PAPERS_SQL


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


def clean(t: str) -> str:
    t = f"nfc_normalize(coalesce({t}, ''))"
    for one, more in fixed.LIGATURES:
        t = f"replace({t}, {quoted(one)}, {quoted(more)})"
    t = f"translate({t}, {quoted(fixed.QUOTES)}, {quoted(fixed.PLAIN_QUOTES)})"
    t = rf"regexp_replace({t}, '[^\P{{C}}\n\t]|[^\P{{Z}} ]', '', 'g')"
    t = rf"regexp_replace({t}, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    t = rf"regexp_replace({t}, '(?im)^.{{0,80}}(page\s+[0-9]+\s+of\s+[0-9]+|doi:\s*10\.[0-9]+|©\s*[0-9]{{4}}|all rights reserved).{{0,80}}$', '', 'g')"
    t = rf"regexp_replace({t}, '(?m)^\s*[0-9]{{1,4}}\s*$', '', 'g')"
    t = rf"regexp_replace({t}, '[ \t]+', ' ', 'g')"
    t = rf"regexp_replace({t}, ' ?\n ?', chr(10), 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(t)


def sentences(t: str, longer_than: int) -> str:
    """A list of sentences."""
    split = rf"string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({split}, lambda s: {strip('s')}), lambda s: length(s) > {longer_than})"


def unnested(source: str, keys: str, lists: str, name: str, first: int = 0) -> str:
    return f"SELECT {keys}, unnest({lists}) AS {name}, generate_subscripts({lists}, 1) - 1 + {first} AS pos FROM {source}"


_REFERENCES = fixed.REFERENCES_LINE
_NAMES = " ".join(f"WHEN regexp_matches(heading, {quoted('(?i)' + p)}) THEN {quoted(n)}" for n, p in fixed.HEADINGS)

BASE = rf"""
papers AS ({PAPERS_SQL}),
clean0 AS (SELECT doc_id, full_text, {clean('full_text')} AS t FROM papers),
clean AS (SELECT doc_id, full_text, CASE WHEN regexp_matches(t, '(?i){_REFERENCES}') THEN
    {strip(f"regexp_extract(t, '(?is)^(.*?){_REFERENCES}', 1)")} ELSE t END AS clean_text FROM clean0),
lines AS (SELECT doc_id, unnest(string_split(clean_text, chr(10))) AS line, generate_subscripts(string_split(clean_text, chr(10)),
    1) - 1 AS lno FROM clean),
heads AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lno) - 1 AS ord, lead(lno) OVER (PARTITION BY doc_id ORDER BY lno) AS
    nxt, row_number() OVER (PARTITION BY doc_id, base ORDER BY lno) AS nth
  FROM (SELECT doc_id, lno, heading, CASE {_NAMES} END AS base FROM (SELECT doc_id, lno, {strip('line')} AS heading FROM lines)
    WHERE length(heading) <= 80 AND regexp_matches(heading, {quoted(fixed.HEADING)})) WHERE base IS NOT NULL),
sections AS (SELECT h.doc_id, h.ord, CASE WHEN nth > 1 THEN base || '_' || h.ord
    ELSE base END AS name, heading, {strip("coalesce(string_agg(l.line, chr(10) ORDER BY l.lno), '')")} AS text, h.lno AS start_line,
    coalesce(nxt, n) - 1 AS end_line
  FROM heads h JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) USING (doc_id)
    LEFT JOIN lines l ON l.doc_id = h.doc_id AND l.lno > h.lno AND l.lno < coalesce(nxt, n) GROUP BY ALL),
preambles AS (SELECT doc_id, {strip("coalesce(string_agg(line, chr(10) ORDER BY lno) FILTER (lno < lead_line), '')")} AS preamble
    FROM lines LEFT JOIN (SELECT doc_id, min(lno) AS lead_line FROM heads GROUP BY doc_id) USING (doc_id) GROUP BY doc_id)
"""


def _slot(name: str, whole: bool) -> str:
    order = " ".join(f"WHEN name = {quoted(a)} THEN {2 * k} WHEN starts_with(name, {quoted(a)}) THEN {2 * k + 1}" for k, a in enumerate(fixed.ALIASES.get(name, [name])))
    t = f"coalesce(arg_min(text, 10000 * (CASE {order} END) + ord) FILTER (text <> '' AND (CASE {order} END) IS NOT NULL), '')"
    return f"{t if whole else f'substr({t}, 1, {fixed.SECTION_CAPS[name]})'} AS s_{name}"


_ORDER = ("abstract", "introduction", "methodology", "results", "discussion", "conclusion")
_SLOTS = ", ".join(f"coalesce(s_{n}, '') AS s_{n}" for n in fixed.SECTION_CAPS)
_COMBINED = ", ".join(f"nullif(s_{n}, '')" for n in _ORDER)


def slots(whole: bool = False) -> str:
    """CTE slots after BASE: the beginnings of sections, or all of them if whole."""
    t = f"concat_ws(chr(10) || chr(10), {_COMBINED})"
    return f"""{BASE},
slots0 AS (SELECT c.doc_id, c.clean_text, {'c.clean_text' if whole else 'substr(c.clean_text, 1, 2000)'} AS start, {_SLOTS} FROM clean c LEFT JOIN
    (SELECT doc_id, {', '.join(_slot(n, whole) for n in fixed.SECTION_CAPS)} FROM sections GROUP BY doc_id) USING (doc_id)),
slots AS (SELECT *, {t if whole else f'substr({t}, 1, {fixed.COMBINED_CAP})'} AS combined FROM slots0)
"""


SLOTS = slots()

_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_STOP = "[" + ", ".join(map(quoted, fixed.STOP_WORDS)) + "]"
_WORD = r"[\p{L}\p{N}_]"
CONTENT = rf"array_to_string(list_filter(regexp_split_to_array(translate(lower(sent), {quoted(_PUNCT)}, ''), '\s+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)), ' ')"
PLAIN = rf"array_to_string(list_filter(regexp_extract_all(lower(sent), '{_WORD}{{2,}}'), lambda w: NOT list_contains({_STOP}, w)), ' ')"


def tfidf(rows: str, words: str = CONTENT, vocabulary: int = 5000, name: str = "") -> str:
    """CTE w{name} (grp, pos, term, w) from a CTE rows (grp, pos, sent)."""
    return rf"""
t0{name} AS (SELECT grp, pos, n, regexp_extract_all({words}, '{_WORD}{{2,}}') AS ws FROM
    (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {rows}) WHERE n > 1),
t1{name} AS (SELECT grp, pos, n, unnest(list_concat(ws, list_transform(range(1, len(ws)),
    lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM t0{name}),
t2{name} AS (SELECT grp, pos, n, term, count(*) AS tf FROM t1{name} GROUP BY ALL),
t3{name} AS (SELECT grp, term, count(*) AS df, sum(tf) AS total FROM t2{name} GROUP BY ALL),
t4{name} AS (SELECT grp, term, df FROM t3{name} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY total DESC, term) <= {vocabulary}),
t5{name} AS (SELECT grp, pos, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS raw FROM t2{name} JOIN t4{name} USING (grp, term)),
w{name} AS (SELECT grp, pos, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY grp, pos)) AS w FROM t5{name})"""


def scored(rows: str, name: str = "") -> str:
    """CTE scored{name} (grp, pos, sent, n, tfidf, similarity, position, score) and placed{name}."""
    scale = lambda c: f"CASE WHEN max({c}) OVER g - min({c}) OVER g < 1e-12 THEN 1.0 ELSE ({c} - min({c}) OVER g) / (max({c}) OVER g - min({c}) OVER g) END"
    return f"""{tfidf(rows, name=name)},
c{name} AS (SELECT grp, term, sum(w) AS c FROM w{name} GROUP BY ALL),
v{name} AS (SELECT grp, count(*) AS v, sqrt(sum(c * c)) AS norm FROM c{name} GROUP BY grp),
s{name} AS (SELECT grp, pos, sum(w) AS mass, sum(w * c) AS dot FROM w{name} JOIN c{name} USING (grp, term) GROUP BY grp, pos),
p{name} AS (SELECT r.grp, r.pos, r.sent, r.n, CASE WHEN v IS NULL THEN 1.0 ELSE coalesce(mass / v, 0.0) END AS tfidf, CASE
    WHEN v IS NULL THEN 1.0 ELSE coalesce(dot / norm, 0.0) END AS similarity,
  greatest(0.0, 1.0 - r.pos / greatest(0.3 * n, 1.0), 1.0 - (n - 1 - r.pos) / greatest(0.3 * n, 1.0))::double AS position FROM
    (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {rows}) r LEFT JOIN s{name} USING (grp, pos) LEFT JOIN v{name} USING (grp)),
scored{name} AS (SELECT *, 0.5 * ({scale('tfidf')}) + 0.3 * ({scale('similarity')}) + 0.2 * ({scale('position')}) AS score
    FROM p{name} WINDOW g AS (PARTITION BY grp)),
placed{name} AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, pos DESC) AS place FROM scored{name})"""


def first_match(t: str, patterns: list[str], group: int) -> str:
    return "coalesce(" + ", ".join(f"nullif({strip(f'regexp_extract({t}, {quoted('(?i)' + p)}, {group})')}, '')" for p in patterns) + ", '')"


def all_matches(t: str, patterns: list[str], longer_than: int, most: int, group: int = 0, any_case: bool = True) -> str:
    """A list, distinct, in order: an entry counts where the list has it first."""
    found = "list_concat(" + ", ".join(f"regexp_extract_all({t}, {quoted(('(?i)' if any_case else '') + p)}, {group})" for p in patterns) + ")"
    kept = f"list_filter(list_transform({found}, lambda x: {strip('x')}), lambda x: length(x) > {longer_than})"
    return f"list_filter({kept}, lambda x, i: list_position({kept}, x) = i)[1:{most}]"


def first_filled(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({n}, '')" for n in names) + ", '')"


def statements(between: str = "'|'") -> str:
    f = fixed
    a, m, r = first_filled("s_abstract", "s_introduction", "start"), first_filled("s_methodology", "combined"), first_filled("s_results", "s_experiments", "s_conclusion", "combined")
    c, d = first_filled("s_abstract", "s_introduction", "s_conclusion", "combined"), first_filled("s_discussion", "s_conclusion", "combined")
    e = first_filled("s_methodology", "s_experiments", "substr(clean_text, 1, 5000)")
    return f"""SELECT doc_id, {first_match(a, f.OBJECTIVE, 1)} AS objective, {first_match(m, f.METHOD, 0)} AS methodology,
    array_to_string({all_matches(r, f.FINDING, 40, 6)}, {between}) AS findings, {first_match(c, f.CONTRIBUTION, 0)} AS contribution,
    array_to_string({all_matches(d, f.LIMITATION, 30, 5)}, {between}) AS limitations,
    array_to_string({all_matches(e, f.DATASET, 3, 5, 1, False)}, ', ') AS datasets FROM slots"""


KEYWORDS = f"""{BASE},
krows AS (SELECT doc_id AS grp, sent, pos FROM ({unnested('clean', 'doc_id', sentences('substr(clean_text, 1, 5000)', 10), 'sent')})),
{tfidf('krows', PLAIN, 200, 'k')},
ks AS (SELECT grp AS doc_id, term, round(sum(w), 9) AS score FROM wk GROUP BY ALL),
keywords AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term DESC) AS rank, term, round(score, 6) AS score
    FROM ks QUALIFY rank <= 15)
"""

_T3 = rf"list_filter(list_filter(list_transform(string_split(clean_text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')[1:10], lambda x: length(x) BETWEEN 10 AND 200 AND NOT regexp_matches(x, '10\.[0-9]{{4,}}/\S+') AND NOT (x = upper(x) AND x <> lower(x)))[1:3]"
TITLE = f"coalesce(list_filter({_T3}, lambda x: length(x) = list_max(list_transform({_T3}, lambda y: length(y))))[1], {quoted(fixed.NO_TITLE)})"
METADATA = rf"""SELECT doc_id, {TITLE} AS title, nullif(regexp_replace(regexp_extract(substr(clean_text, 1, 3000),
    '10\.[0-9]{{4,}}/\S+'), '[.,)]+$', ''), '') AS doi,
  nullif(regexp_extract(substr(clean_text, 1, 2000), '\b(19|20)[0-9]{{2}}\b'), '') AS year,
  list_filter(list_transform(string_split(substr(clean_text, 1, 3000), chr(10) || chr(10)), lambda x: {strip('x')}),
    lambda x: length(x) > 200)[1] AS abstract_paragraph,
  array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(string_split(full_text, chr(10))[2], ''),
    '(?i)[,;]|\band\b'), lambda x: {strip('x')}), lambda x: length(x) > 2), '|') AS authors FROM clean"""

_SCORE = lambda cues: " + ".join(f"contains(t, {quoted(c)})::int" for c in cues)
_BEST = "greatest(" + ", ".join(f"({_SCORE(c)})" for _, c in fixed.DOMAINS) + ")"
DOMAIN = f"""{KEYWORDS},
named AS (SELECT c.doc_id, lower(coalesce(k.ks, '')) || ' ' || lower({TITLE}) AS t FROM clean c LEFT JOIN
    (SELECT doc_id, string_agg(term, ' ' ORDER BY rank) AS ks FROM keywords GROUP BY doc_id) k USING (doc_id)),
domains AS (SELECT doc_id, CASE WHEN {_BEST} = 0 THEN {quoted(fixed.NO_DOMAIN)}
    {' '.join(f"WHEN ({_SCORE(c)}) = {_BEST} THEN {quoted(n)}" for n, c in fixed.DOMAINS)} END AS domain FROM named)
"""


def chunk_rows(longer_than: int = 20, size: int = 5, overlap: int = 2) -> str:
    step = size - overlap
    return f"""
parts AS (SELECT doc_id, ord, name, text FROM sections WHERE text <> '' AND name <> 'references'
    UNION ALL SELECT doc_id, 0, 'full_document', clean_text FROM clean WHERE doc_id NOT IN (SELECT doc_id FROM sections)),
listed AS (SELECT doc_id, ord, name, {sentences('text', longer_than)} AS ss FROM parts),
cut AS (SELECT doc_id, ord, name, unnest(list_transform(range(0, 1 + greatest(0, ceil((len(ss) - {size}) / {step}.0))::bigint),
    lambda k: {{'k': k, 'w': ss[k * {step} + 1:k * {step} + {size}]}})) AS c FROM listed WHERE len(ss) > 0),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, c.k) - 1 AS chunk_id, name AS section_name,
    array_to_string(c.w, ' ') AS text, len(c.w) AS n_sentences FROM cut)"""


PAGES = """fx_pages AS (SELECT doc_id, p AS page_number, substr(full_text, 1500 * (p - 1) + 1, 1500) AS raw_text
  FROM (SELECT doc_id, full_text, unnest(range(1, 2 + (greatest(length(full_text), 1) - 1) // 1500)) AS p FROM papers)
  UNION ALL SELECT -1 - doc_id, 1, substr(full_text, 1, 40) FROM papers WHERE doc_id % 10 = 9)"""


_HEX = "'0123456789abcdef'"


def hashed(t: str, size: int = 64) -> str:
    """A list of counts of words by the first byte of their MD5, modulo size."""
    byte = f"((strpos({_HEX}, substr(md5(w), 1, 1)) - 1) * 16 + strpos({_HEX}, substr(md5(w), 2, 1)) - 1)"
    places = f"list_transform(regexp_extract_all(lower({t}), '{_WORD}+'), lambda w: {byte} % {size})"
    return f"list_transform(range(0, {size}), lambda k: len(list_filter({places}, lambda x: x = k))::double)"


#: CTE chunks with page_numbers (a list), from the CTEs of BASE, chunk_rows and PAGES.
PAGED = f"""
pt AS (SELECT doc_id, page_number, {clean('raw_text')} AS page FROM fx_pages),
needles AS (SELECT doc_id, chunk_id, {strip('substr(text, 1, 60)')} AS needle FROM chunks),
paged AS (SELECT n.doc_id, n.chunk_id, coalesce(string_agg(page_number::varchar, ',' ORDER BY page_number), '') AS pages
  FROM needles n LEFT JOIN pt ON pt.doc_id = n.doc_id AND needle <> '' AND contains(page, needle) GROUP BY n.doc_id, n.chunk_id)"""

_QSTOP = "[" + ", ".join(map(quoted, fixed.QUESTION_STOP_WORDS)) + "]"


def answered(source: str, keys: str) -> str:
    """CTE r (keys, question, context, answer, score, found_in_paper) from source (keys, question, context)."""
    words = lambda t: rf"list_distinct(regexp_extract_all(lower({t}), '{_WORD}+'))"
    split = "string_split(regexp_replace(substr(context, 1, 15000), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    content = f"list_filter(ws, lambda w: NOT list_contains({_QSTOP}, w))"
    return f"""
qw AS (SELECT *, {words('question')} AS ws FROM {source}),
qc AS (SELECT *, CASE WHEN len({content}) > 0 THEN {content}
    ELSE ws END AS cw, list_filter(list_transform({split}, lambda s: {strip('s')}), lambda s: length(s) > 15) AS ss FROM qw),
qe AS (SELECT {keys}, cw, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM qc),
qb AS (SELECT {keys}, arg_max(s, score - i * 1e-9) AS best, max(score) AS score FROM
    (SELECT *, len(list_intersect({words('s')}, cw)) / (len(cw) + 0.1) AS score FROM qe) GROUP BY {keys}),
qm AS (SELECT qc.*, best, score, coalesce(trim(question), '') = '' OR coalesce(trim(context),
    '') = '' OR len(ss) = 0 AS none, coalesce(score > 0.2, false) AS hit FROM qc LEFT JOIN qb USING ({keys})),
r AS (SELECT {keys}, question, context, CASE WHEN none THEN {quoted(fixed.NO_CONTEXT)} WHEN hit THEN best
    ELSE {quoted(fixed.NO_ANSWER)} END AS answer,
  CASE WHEN NOT none AND hit THEN round(least(0.95, score), 4) ELSE 0.0 END::double AS score, NOT none AND hit AS found_in_paper FROM qm)"""


def directions(words: list[str] | None) -> str:
    """CTE directions (doc_id, place, topic, question, reason, evidence, is_inferred) after SLOTS, with the same keywords for all.

    words: None takes each document's own, from a CTE own_words (doc_id, ks).

    The folds are recursive: a candidate after the other, with what has been found so far.
    """
    f = fixed
    hits = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS pat, unnest(hs) AS hit, generate_subscripts(hs, 1) AS i FROM
    (SELECT doc_id, list_filter(list_transform(regexp_extract_all(search, {quoted('(?i)' + p)}, 0), lambda x: {strip('x')}),
    lambda x: length(x) >= 30) AS hs FROM searched)"""
        for k, p in enumerate(f.FUTURE)
    )
    new = lambda x: f"list_contains(list_transform(found, lambda d: lower(substr(d.x, 1, 60))), lower(substr({x}, 1, 60)))"
    after = f"CASE WHEN c.pat = f.over OR {new('c.hit')} THEN f.found ELSE list_append(f.found, {{'inferred': 0, 'x': c.hit}}) END"
    limited = f"CASE WHEN len(f.found) >= 5 OR length(c.x) < 30 OR {new('c.x')} THEN f.found ELSE list_append(f.found, {{'inferred': 1, 'x': c.x}}) END"
    limits = all_matches(first_filled("s_discussion", "s_conclusion", "combined"), f.LIMITATION, 30, 5)
    ks = "([" + ", ".join(map(quoted, words)) + "]::VARCHAR[])" if words else "ks"
    known = f"coalesce({quoted(f.EXTENDING[0])} || list_filter({ks}[1:5], lambda k: contains(lower(x), lower(k)))[1] || {quoted(f.EXTENDING[1])}"
    topic = known + ", regexp_replace(array_to_string(regexp_split_to_array(x, '\\s+')[1:8], ' '), '[.,;:]+$', ''))"
    asked = f"regexp_replace(regexp_replace(x, {quoted('(?i)' + f.FUTURE_START)}, {quoted(f.ASKED)}, 'g'), {quoted('(?i)' + f.ACTOR_START)}, {quoted(f.ASKED)})"
    question = f"substr(CASE WHEN ends_with({asked}, '?') THEN {asked} ELSE regexp_replace({asked}, '\\.+$', '') || '?' END, 1, 250)"
    cut = lambda n: f"regexp_replace(substr(x, 1, {n}), '[.,]+$', '')"
    some = lambda n: f"array_to_string({ks}[1:{n}], ', ')"
    templates = [
        ("'Scalability and efficiency'", f"'Can the proposed approach scale to larger datasets or more domains (' || {some(2)} || ')?'", "'Scalability is a common challenge in research; extending the work to larger or more diverse settings is valuable.'", f"'Inferred from research domain keywords: ' || {some(4)}"),
        ("'Cross-domain generalization'", f"'How well does the method generalize beyond its tested domain, particularly for ' || coalesce({ks}[1], 'the studied problem') || '?'", "'Generalization across domains is a key open challenge in most ML research.'", "'Inferred from the scope of evaluation described in findings.'"),
        ("'Robustness and fairness evaluation'", "'Are there biases or robustness issues in the proposed approach that could affect real-world deployment?'", "'Responsible AI research requires evaluation of fairness, bias, and adversarial robustness.'", "'Inferred: no explicit fairness/robustness analysis was identified in the paper.'"),
    ]
    with_words = "" if words else " JOIN own_words USING (doc_id)"
    filled = " UNION ALL ".join(f"SELECT doc_id, n + {k} AS place, {', '.join(t)}, true FROM led{with_words} WHERE n < {3 - k}" for k, t in enumerate(templates))
    return f"""
searched AS (SELECT doc_id, s_conclusion || chr(10) || s_discussion AS search FROM slots),
cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pat, i) AS k FROM ({hits})),
fold AS (SELECT doc_id, 0 AS k, []::STRUCT(inferred INTEGER, x VARCHAR)[] AS found, -1 AS over FROM slots
  UNION ALL SELECT f.doc_id, f.k + 1, {after}, CASE WHEN c.pat <> f.over AND len({after}) >= 5 THEN c.pat ELSE f.over END FROM fold f
    JOIN cand c ON c.doc_id = f.doc_id AND c.k = f.k + 1),
explicit AS (SELECT doc_id, found FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1),
lims AS (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS k FROM (SELECT doc_id, {limits} AS xs FROM slots)),
fold2 AS (SELECT doc_id, 0 AS k, found FROM explicit
  UNION ALL SELECT f.doc_id, f.k + 1, {limited} FROM fold2 f JOIN lims c ON c.doc_id = f.doc_id AND c.k = f.k + 1),
led AS (SELECT doc_id, found, len(found) AS n FROM fold2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1),
each AS (SELECT doc_id, unnest(found).inferred AS inferred, unnest(found).x AS x, generate_subscripts(found, 1) - 1 AS place FROM led),
directions AS (SELECT * FROM (
  SELECT doc_id, place, CASE WHEN inferred = 0 THEN {topic} ELSE {quoted(f.ADDRESSING)} || {cut(60)} END AS topic,
    CASE WHEN inferred = 0 THEN {question} ELSE {quoted(f.OVERCOME[0])} || {cut(120)} || {quoted(f.OVERCOME[1])} END AS question,
    CASE WHEN inferred = 0 THEN {quoted(f.EXPLICIT_REASON)}
    ELSE {quoted(f.LIMITATION_REASON)} END AS reason, substr(x, 1, 300) AS evidence, false AS is_inferred FROM each{with_words}
  UNION ALL {filled}) WHERE place < 6)"""


def phrases() -> str:
    """CTE scores (doc_id, phrase, n, score) after BASE: runs of up to three words by the statistics of their words."""
    blocks = rf"regexp_split_to_array(sent, {quoted(fixed.BLOCK_END)})"
    words = f"regexp_extract_all(b, '{_WORD}+')"
    block = "(PARTITION BY doc_id, sent_no, block ORDER BY spot)"
    term = "(PARTITION BY doc_id, term)"
    share = lambda c: f"coalesce(count(DISTINCT {c}) / nullif(count({c}), 0), 0.0)"
    return rf"""
ys AS (SELECT doc_id, sent, pos AS sent_no FROM ({unnested('clean', 'doc_id', sentences('clean_text', 0), 'sent')})),
yb AS (SELECT doc_id, sent_no, unnest({blocks}) AS b, generate_subscripts({blocks}, 1) - 1 AS block FROM ys),
yw AS (SELECT doc_id, sent_no, block, unnest({words}) AS word, generate_subscripts({words}, 1) - 1 AS spot FROM yb),
yk AS (SELECT *, lower(word) AS term, CASE WHEN NOT regexp_matches(word, '\p{{L}}') THEN 'number'
    WHEN list_contains({_STOP}, lower(word)) OR length(word) < 3 THEN 'stop' ELSE 'word' END AS kind FROM yw),
yn AS (SELECT *, lag(term) OVER {block} AS before, lead(term) OVER {block} AS next1, lead(kind) OVER {block} AS kind1,
    lead(term, 2) OVER {block} AS next2, lead(kind, 2) OVER {block} AS kind2 FROM yk),
yt AS (SELECT doc_id, term, any_value(kind) AS kind, count(*) AS tf, median(sent_no) AS middle, count(DISTINCT sent_no) AS in_sents,
    {share('before')} + {share('next1')} AS sides,
    greatest(count(*) FILTER (regexp_matches(word, '^\p{{Lu}}') AND NOT (block = 0 AND spot = 0)),
    count(*) FILTER (length(word) > 1 AND word = upper(word) AND word <> term)) AS cased
  FROM yn GROUP BY doc_id, term),
yd AS (SELECT doc_id, avg(tf) FILTER (kind = 'word') + stddev_pop(tf) FILTER (kind = 'word') AS usual, max(tf) AS most FROM yt
    GROUP BY doc_id),
yl AS (SELECT doc_id, max(sent_no) + 1 AS sents FROM yw GROUP BY doc_id),
yr AS (SELECT *, 1.0::double + sides * tf / most AS rel FROM yt JOIN yd USING (doc_id) JOIN yl USING (doc_id)),
yv AS (SELECT doc_id, term, tf, rel * ln(ln(3.0 + middle)) / (cased / (1.0 + ln(tf)) + (tf / usual) / rel + (in_sents / sents) / rel) AS
    weight FROM yr),
yp AS (SELECT doc_id, term, next1, count(*) AS follows FROM yn WHERE next1 IS NOT NULL GROUP BY ALL),
yc AS (SELECT yn.*, a.weight AS w, b.weight AS w1, c.weight AS w2, (p.follows / a.tf) * (q.follows / b.tf) AS bound
  FROM yn JOIN yv a USING (doc_id, term) LEFT JOIN yv b ON b.doc_id = yn.doc_id AND b.term = yn.next1
    LEFT JOIN yv c ON c.doc_id = yn.doc_id AND c.term = yn.next2
  LEFT JOIN yp p ON p.doc_id = yn.doc_id AND p.term = yn.term AND p.next1 = yn.next1
  LEFT JOIN yp q ON q.doc_id = yn.doc_id AND q.term = yn.next1 AND q.next1 = yn.next2 WHERE yn.kind = 'word'),
ye AS (SELECT doc_id, term AS phrase, 1 AS n, w AS times, w AS plus FROM yc
  UNION ALL SELECT doc_id, term || ' ' || next1, 2, w * w1, w + w1 FROM yc WHERE kind1 = 'word'
  UNION ALL SELECT doc_id, term || ' ' || next1 || ' ' || next2, 3, w * (CASE kind1 WHEN 'stop' THEN 2.0 - bound
    ELSE w1 END) * w2, w + (CASE kind1 WHEN 'stop' THEN bound - 1.0 ELSE w1 END) + w2
    FROM yc WHERE kind1 IN ('word', 'stop') AND kind2 = 'word'),
scores AS (SELECT doc_id, phrase, n, any_value(times) / (count(*) * (1.0 + any_value(plus))) AS score FROM ye GROUP BY doc_id, phrase, n)"""


def sparse_top(source: str, keys: str, most: int = 5) -> str:
    """CTE sparse_top (query_id, keys, rank, score): all rows of source (keys, text) against the first sentences of rows (grp, pos, sent), exhaustively."""
    words = f"regexp_extract_all({CONTENT}, '{_WORD}{{2,}}')"
    return f"""
st AS (SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, unnest({words}) AS term FROM (SELECT {keys}, text AS sent FROM {source})) GROUP BY ALL),
si AS (SELECT term, ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + count(*))) + 1.0 AS idf FROM st GROUP BY term),
sw AS (SELECT {keys}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {keys})) AS w FROM
    (SELECT {keys}, term, tf * idf AS raw FROM st JOIN si USING (term))),
sq AS (SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS q FROM
    (SELECT query_id, term, any_value(idf) * count(*) AS raw FROM (SELECT grp AS query_id, unnest({words}) AS term FROM rows
    WHERE pos = 0 AND grp % 100 = 0) JOIN si USING (term) GROUP BY query_id, term)),
sr AS (SELECT query_id, {keys}, round(sum(q * w), 9) AS score FROM sq JOIN sw USING (term) GROUP BY query_id, {keys}),
sparse_top AS (SELECT query_id, {keys}, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {keys}) AS rank, round(score, 6) AS score
    FROM sr WHERE score > 0.1 QUALIFY rank <= {most})"""


#: CTE key_phrases (doc_id, rank, phrase, score) after BASE and phrases(), by a recursive fold. Edits are counted by code
#: point: letters beyond ASCII, few in two phrases, are written as capitals first, of which a phrase has none.
_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_LETTERS = "array_to_string(list_distinct(regexp_extract_all(d.phrase || e.phrase, '[^\\x00-\\x7f]')), '')"
_NEAR = f"""1.0 - levenshtein(translate(d.phrase, {_LETTERS}, {_CAPITALS}), translate(e.phrase, {_LETTERS}, {_CAPITALS}))
    / greatest(length(d.phrase), length(e.phrase))"""
KEY_PHRASES = f"""
kpo AS (SELECT doc_id, phrase, round(score, 12) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12), phrase) AS k FROM scores),
kpf AS (SELECT doc_id, 0::BIGINT AS k, []::STRUCT(score DOUBLE, phrase VARCHAR)[] AS done FROM clean
  UNION ALL SELECT f.doc_id, f.k + 1, CASE WHEN len(list_filter(f.done, lambda d: {_NEAR} > 0.7)) > 0 THEN f.done
    ELSE list_append(f.done, {{'score': e.score, 'phrase': e.phrase}}) END FROM kpf f JOIN kpo e ON e.doc_id = f.doc_id AND e.k = f.k + 1
    WHERE len(f.done) < 20),
kpl AS (SELECT doc_id, done[1:15] AS best FROM kpf QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1),
key_phrases AS (SELECT doc_id, generate_subscripts(best, 1) AS rank, unnest(best).phrase AS phrase, unnest(best).score AS score FROM kpl)"""


def listed(joined: str) -> str:
    """The list that was joined by chr(1); an empty one gave the empty text."""
    return f"CASE WHEN {joined} = '' THEN []::VARCHAR[] ELSE string_split({joined}, chr(1)) END"


#: CTE analysis: one row for each document, lists as lists, after the CTE `keyed` of the insights (and what that needs) and `st`.
ANALYSIS = f"""{KEYWORDS.removeprefix(BASE)}{DOMAIN.removeprefix(KEYWORDS)},
own_words AS (SELECT c.doc_id, coalesce(list(term ORDER BY rank) FILTER (term IS NOT NULL), []::VARCHAR[]) AS ks FROM clean c
    LEFT JOIN keywords USING (doc_id) GROUP BY c.doc_id),
{directions(None)},
meta AS ({METADATA}),
counted AS (SELECT doc_id, count(*) AS n_sections FROM sections GROUP BY doc_id),
have AS (SELECT DISTINCT doc_id FROM best WHERE slot LIKE 'point%'),
some_points AS (SELECT doc_id, slot, pos, sent FROM best WHERE slot LIKE 'point%' OR (slot = 'main' AND doc_id NOT IN (SELECT doc_id FROM have))),
first_points AS (SELECT * FROM some_points QUALIFY row_number() OVER (PARTITION BY doc_id, substr(sent, 1, 50) ORDER BY slot, pos) = 1),
points AS (SELECT doc_id, list(sent ORDER BY slot, pos)[1:8] AS main_points FROM first_points GROUP BY doc_id),
ways AS (SELECT doc_id, list({{'topic': topic, 'question': question, 'reason': reason, 'evidence': evidence, 'is_inferred': is_inferred}}
    ORDER BY place) AS directions FROM directions GROUP BY doc_id),
analysis AS (SELECT k.doc_id, m.title, m.year, m.doi, coalesce(n_sections, 0) AS n_sections, k.objective, k.methodology,
    {listed('k.findings')} AS findings, k.contribution, {listed('st.limitations')} AS limitations, st.datasets,
    coalesce(main_points, []::VARCHAR[]) AS main_points, k.summary, k.conclusion, key_insight, coalesce(two, key_insight) AS simple_explanation,
    CASE WHEN k.findings <> '' THEN array_to_string(fs[1:2], ' ') ELSE coalesce(two, key_insight) END AS why_it_matters,
    ks AS keywords, domain, directions
  FROM keyed k JOIN st USING (doc_id) JOIN meta m USING (doc_id) JOIN own_words USING (doc_id) JOIN domains USING (doc_id)
    JOIN ways USING (doc_id) LEFT JOIN counted USING (doc_id) LEFT JOIN points USING (doc_id))"""
