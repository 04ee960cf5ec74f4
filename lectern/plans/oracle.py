"""Second formulations in DuckDB SQL: marks and list functions where the plans use look-around and zips."""

from __future__ import annotations

# Fixed values, written out again: an error in the plans' own tables must not pass.
ABBREVIATIONS = "mr|mrs|ms|dr|prof|sr|jr|st|vs|etc|dept|est|govt|inc|corp|ltd|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec|ave|blvd|rd|ln"
_UNITS = ["", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
_TEENS = ["ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
_TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES = ["", "thousand", "million", "billion", "trillion"]
CATEGORIES = [("business-politics", "Business & Politics"), ("culture-society", "Culture & Society"), ("health-lifestyle", "Health & Lifestyle"), ("science-technology", "Science & Technology"), ("travel-experiences", "Travel & Experiences")]
VOICES = ["af_sarah", "af_nicole", "af_sonia", "af_reese", "af_liam", "am_michael", "am_michael_2", "am_adam", "am_mic...tral", "bf_emma", "bf_ella", "bf_isabella", "bf_lily", "bm_george", "bm_leon", "bf_rare_1", "bf_rare_2"]

#: The words of 0 (none) to 99, and of 0 to 999 from them.
_BELOW_HUNDRED = [*_UNITS, *_TEENS, *[f"{ten}-{unit}" if unit else ten for ten in _TENS for unit in _UNITS]]
_BELOW_THOUSAND = [" ".join(filter(None, [f"{hundreds} hundred" if hundreds else "", rest])) for hundreds in _UNITS for rest in _BELOW_HUNDRED]


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: One row: h, words of 0 to 999 (0 is empty), o, names of digits.
NUMBER_WORDS = f"number_words as (select {_list(_BELOW_THOUSAND)} as h, {_list(["zero", *_UNITS[1:]])} as o)"


def whole(digits: str) -> str:
    """Words of a string of digits; null beyond 15 of them."""
    n = f"(case when length(ltrim({digits}, '0')) <= 15 then ({digits})::bigint end)"
    chunks = []
    for power in range(len(SCALES) - 1, -1, -1):
        c = f"({n} // {1000**power} % 1000)"
        scale = f" || ' {SCALES[power]}'" if power else ""
        chunks.append(f"case when {c} > 0 then h[{c} + 1]{scale} end")
    return f"(case when {n} = 0 then 'zero' when {n} > 0 then concat_ws(' ', {', '.join(chunks)}) end)"


def names(digits: str) -> str:
    return f"array_to_string(list_transform(string_split({digits}, ''), lambda c: o[c::int + 1]), ' ')"


def spelled(match: str) -> str:
    """Words of the only number in a match."""
    number = f"replace(regexp_extract({match}, '[0-9][0-9,.]*'), ',', '')"
    return f"(case when contains({number}, '.') then {whole(f'split_part({number}, {chr(39)}.{chr(39)}, 1)')} || ' point ' || {names(f'split_part({number}, {chr(39)}.{chr(39)}, 2)')} else {whole(number)} end)"


def replaced(text: str, pattern: str, said) -> str:
    """Text with every match of an RE2 pattern given way to said(match)."""
    return f"""array_to_string(list_transform(range(1, len(string_split_regex({text}, '{pattern}')) + 1),
        lambda i: string_split_regex({text}, '{pattern}')[i] || coalesce(coalesce({said(f"regexp_extract_all({text}, '{pattern}')[i]")}, regexp_extract_all({text}, '{pattern}')[i]), '')), '')"""


_A, _Z = "\\x{E000}", "\\x{E001}"
#: Every run of word characters between two marks: a match can then neither begin nor end inside one.
_MARKED = "regexp_replace({t}, '([\\p{{L}}\\p{{N}}_]+)', chr(57344) || '\\1' || chr(57345), 'g')"
_PLAIN = "translate({t}, chr(57344) || chr(57345), '')"

_GROUPED = "\\p{Nd}{1,3}(?:,\\p{Nd}{3})*"
#: name, pattern, what is said, whether words are marked.
RULES = (
    ("scaled_dollars", f"\\${_GROUPED}\\s*(?:billion|million|trillion|thousand)\\b", lambda m: f"({spelled(m)} || ' ' || regexp_extract({m}, '[a-z]+$') || ' dollars')", False),
    ("dollars", f"\\${_GROUPED}", lambda m: f"({spelled(m)} || ' dollars')", False),
    ("percent", "\\p{Nd}+(?:\\.\\p{Nd}+)?\\s*%", lambda m: f"({spelled(m)} || ' percent')", False),
    ("decimals", f"{_A}\\p{{Nd}}+{_Z}\\.{_A}\\p{{Nd}}+{_Z}", spelled, True),
    ("commas", f"{_A}\\p{{Nd}}{{1,3}}{_Z}(?:,{_A}\\p{{Nd}}{{3}}{_Z})+", spelled, True),
    ("long_integers", f"{_A}\\p{{Nd}}{{5,}}{_Z}", spelled, True),
)


def rule_query(name: str, source: str) -> str:
    """source: SQL of (doc_id, t)."""
    return f"with src as ({source}), {NUMBER_WORDS}, {_steps([name])} select doc_id, t as said from step_1"


def _steps(rules: list[str]) -> str:
    out, before = [], "src"
    for n, name in enumerate(rules, 1):
        _, pattern, said, marked = next(r for r in RULES if r[0] == name)
        t = _MARKED.format(t="t") if marked else "t"
        out.append(f"mark_{n} as (select doc_id, {t} as t from {before})")
        put = replaced("t", pattern, (lambda m, said=said: said(_PLAIN.format(t=m))) if marked else said)
        out.append(f"step_{n} as (select doc_id, {_PLAIN.format(t=put) if marked else put} as t from mark_{n}, number_words)")
        before = f"step_{n}"
    return ", ".join(out)


PRN_SHOWN = "regexp_replace({t}, '\\{{\\{{prn:(?:([^}}|]+)(?:\\|[^}}]*)?|\\|[^}}]*)\\}}\\}}', '\\1', 'g')"
PRN_SAID = "regexp_replace(regexp_replace({t}, '\\{{\\{{prn:[^}}|]*\\|([^}}]*)\\}}\\}}', '\\1', 'g'), '\\{{\\{{prn:([^}}|]+)\\}}\\}}', '\\1', 'g')"


def speech_query(source: str) -> str:
    said = PRN_SAID.format(t="t")
    return f"with raw as ({source}), src as (select doc_id, {said} as t from raw), {NUMBER_WORDS}, {_steps([r[0] for r in RULES])} select doc_id, t as tts from step_{len(RULES)}"


PARAGRAPHS = r"""
    select doc_id, para_pos, regexp_replace(line, '^\s+|\s+$', '', 'g') as para from (
        select doc_id, unnest(l) as line, unnest(range(0, len(l)))::int as para_pos
        from (select doc_id, string_split_regex(text, '\r\n|\r|\n') as l from documents)
    ) where regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''"""


def guarded(text: str) -> str:
    """Guarded enders get a mark before them; twice, as a match takes the character before the word with it."""
    for _ in range(2):
        text = rf"regexp_replace({text}, '(^|[^\p{{L}}])((?i:{ABBREVIATIONS})|\p{{L}})([.!?])', '\1\2' || chr(57344) || '\3', 'g')"
    return text


def sentence_rows(paras: str = PARAGRAPHS) -> str:
    """(doc_id, para_pos, sent_pos, raw) from SQL of (doc_id, para_pos, para)."""
    cut = rf"""regexp_replace({guarded("para")}, '([^\x{{E000}}][.!?]"*)\s+([\p{{Lu}}"])', '\1' || chr(57345) || '\2', 'g')"""
    return f"""
    select doc_id, para_pos, unnest(range(0, len(l)))::int as sent_pos, translate(unnest(l), chr(57344), '') as raw
    from (select doc_id, para_pos, string_split({cut}, chr(57345)) as l from ({paras}))"""


SENTENCES = f"select doc_id, (row_number() over (partition by doc_id order by para_pos, sent_pos) - 1)::int as sent_id, raw from ({sentence_rows()})"

# --- segments: folds as recursive queries, pieces as strings -----------------------------------------------------------

#: Fixed values, written out again: the word lists of the regrouping rules.
_CONJUNCTIONS = "and but or nor yet so because although though while whereas when whenever if unless until once since as after before"
_PREPOSITIONS = "in on at by for with without from to about through across during despite including according"
_NEVER_LAST = "a an the to in on at for with by of and or but nor yet"
_NEVER_FIRST = "a an to of"
_PRONOUNS = "you me him her us them"
_AUXILIARIES = "don't doesn't didn't won't wouldn't can't couldn't shouldn't mightn't mustn't is are was were has have had do does did will would can could should may might must shall"
_EDGE, _EDGE_FIRST, _EDGE_GRAMMAR = "\",;:!?.-—–''", "\",;:!?.-—''", "\",;:!?.()-—"


def _among(word: str, words: str, edge: str) -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in words.split())
    return f"lower(trim({word}, '{edge}')) in ({listed})"


def _stops(text: str) -> str:
    return f"right({text}, 1) in ('.', '!', '?')"


_FILLED = "list_reduce(list_transform(string_split_regex(trim(c), '\\s+'), lambda w: [w]), lambda a, x: case when length(a[-1]) + 1 + length(x[1]) <= 45 then list_concat(a[1:len(a) - 1], [a[-1] || ' ' || x[1]]) else list_concat(a, x) end)"
_CLAUSES = f"flatten(list_transform(list_filter(string_split(regexp_replace(p, '([,;])\\s+', '\\1' || chr(57344), 'g'), chr(57344)), lambda c: trim(c) <> ''), lambda c: case when length(c) <= 45 then [regexp_replace(trim(c), '\\s+', ' ', 'g')] else {_FILLED} end))"
_CUT = f"flatten(list_transform(list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(57344), 'g'), chr(57344)), lambda p: trim(p) <> ''), lambda p: case when length(p) <= 45 then [regexp_replace(trim(p), '\\s+', ' ', 'g')] else {_CLAUSES} end))"

_APPEND = "{'done': list_concat(done, [p]), 'todo': todo[2:]}"
_BACK = "{'done': list_concat(done[1:len(done) - 1], [done[-1] || ' ' || p]), 'todo': todo[2:]}"
_AHEAD = "{'done': list_concat(done, [p || ' ' || todo[2]]), 'todo': todo[3:]}"
_CAN_BACK = "(len(done) > 0 and length(done[-1]) + 1 + length(p) <= 75)"
_CAN_AHEAD = "length(p) + 1 + length(todo[2]) <= 75"
_ABSORBED = f"""case
    when length(p) >= 22 or (len(done) = 0 and len(todo) = 1) then {_APPEND}
    when len(todo) = 1 then {_BACK}
    when {_stops('p')} then case when {_CAN_BACK} then {_BACK} else {_APPEND} end
    when right(p, 1) = ',' and len(done) > 0 and {_stops('done[-1]')} then case when {_CAN_AHEAD} then {_AHEAD} else {_APPEND} end
    when right(p, 1) = ',' and len(done) > 0 then case when {_CAN_BACK} then {_BACK} when {_CAN_AHEAD} then {_AHEAD} else {_APPEND} end
    when {_CAN_AHEAD} then {_AHEAD} when {_CAN_BACK} then {_BACK} else {_APPEND} end"""


def _smoothed(name: str, source: str) -> str:
    """CTEs ``name`` of (doc_id, sent_id, l) from ``source``."""
    moves = f"coalesce(list_position(list_transform(range(len(w), 0, -1), lambda i: {_among('w[i]', _NEVER_LAST, _EDGE)} and not (i > 1 and {_stops('w[greatest(i - 1, 1)]')})), false) - 1, len(w))"
    joined = f"list_reduce(list_transform(moved, lambda x: [x]), lambda a, x: case when {_among(f'split_part(x[1], {chr(39)} {chr(39)}, 1)', _NEVER_FIRST, _EDGE_FIRST)} and length(a[-1]) + 1 + length(x[1]) <= 65 then list_concat(a[1:len(a) - 1], [a[-1] || ' ' || x[1]]) else list_concat(a, x) end)"
    return f"""
    {name}_moves as (
        select doc_id, sent_id, []::varchar[] as moved, []::varchar[] as carry, l as todo from {source}
        union all
        select doc_id, sent_id, case when len(w) > k then list_concat(moved, [array_to_string(w[1:len(w) - k], ' ')]) else moved end, w[len(w) - k + 1:], todo[2:]
        from (select *, case when len(todo) > 1 then {moves} else 0 end as k from (select *, list_concat(carry, string_split(todo[1], ' ')) as w from {name}_moves where len(todo) > 0))),
    {name} as (select doc_id, sent_id, {joined} as l from {name}_moves where len(todo) = 0)"""


_PLACES = f"""list_min(list_filter(list_transform(range(1, len(w) - 1), lambda i: case
    when ((length(array_to_string(w[1:i], ' ')) + 1 > 15 and length(x) - length(array_to_string(w[1:i], ' ')) > 15 and ({_among('w[i + 1]', _CONJUNCTIONS, _EDGE_GRAMMAR)} or w[i + 1] in ('—', '–')))
        or (length(array_to_string(w[1:i], ' ')) + 1 > 25 and {_among('w[i + 1]', _PREPOSITIONS, _EDGE_GRAMMAR)}))
    then {{'cost': abs(i - len(w) // 2) - (case when w[i + 1] in ('—', '–') then 3 else 0 end), 'i': i}} end), lambda s: s is not null))['i']"""
_TOO_LONG = "list_min(list_filter(range(2, len(w)), lambda i: length(array_to_string(w[1:i + 1], ' ')) + 1 > 50))"


def segment_rows(sentences: str = SENTENCES) -> str:
    """(doc_id, sent_id, seg_pos, segment) from SQL of (doc_id, sent_id, raw)."""
    return f"""
    with recursive source as materialized (select doc_id, sent_id, raw as t from ({sentences})),
    cut as materialized (select doc_id, sent_id, {_CUT} as l from source where length(t) > 65),
    absorbing as (
        select doc_id, sent_id, []::varchar[] as done, l as todo from cut where len(l) > 1
        union all
        select doc_id, sent_id, s['done'], s['todo'] from (select doc_id, sent_id, {_ABSORBED} as s from (select *, todo[1] as p from absorbing where len(todo) > 0))),
    absorbed as (select doc_id, sent_id, done as l from absorbing where len(todo) = 0),
    {_smoothed('smooth', 'absorbed')},
    joining as (
        select doc_id, sent_id, []::varchar[] as done, false as settled, l as todo from smooth
        union all
        select doc_id, sent_id, case when j then list_concat(done[1:len(done) - 1], [done[-1] || ' ' || todo[1]]) else list_concat(done, [todo[1]]) end, j, todo[2:]
        from (select *, coalesce(len(done) > 0 and not settled and {_among("regexp_extract(done[-1], '[^ ]+$')", _PRONOUNS, _EDGE)} and {_among("split_part(todo[1], ' ', 1)", _AUXILIARIES, _EDGE)}, false) as j from joining where len(todo) > 0)),
    splitting as (
        select doc_id, sent_id, lpad(i::varchar, 5, '0') as path, done[i] as x, length(done[i]) > 65 as open from (select *, unnest(range(1, len(done) + 1)) as i from joining where len(todo) = 0)
        union all
        select doc_id, sent_id, path || side, case when cut_at is null then x when side = 0 then array_to_string(w[1:cut_at], ' ') else array_to_string(w[cut_at + 1:], ' ') end,
            again and length(case when side = 0 then array_to_string(w[1:cut_at], ' ') else array_to_string(w[cut_at + 1:], ' ') end) > 65
        from (select *, coalesce(best, late) as cut_at, best is not null as again, unnest(case when best is null and late is null then [0] else [0, 1] end) as side
            from (select *, case when len(w) > 3 then {_PLACES} end as best, case when len(w) > 3 then {_TOO_LONG} end as late from (select *, string_split(x, ' ') as w from splitting where open)))),
    grown as (select doc_id, sent_id, list(x order by path) as l from splitting where not open group by doc_id, sent_id),
    {_smoothed('evened', 'grown')},
    whole as (select doc_id, sent_id, case when len(l) > 1 then l else [t] end as l from source left join evened using (doc_id, sent_id))
    select doc_id, sent_id, unnest(range(0, len(l)))::int as seg_pos, unnest(l) as segment from whole"""


SEGMENTS = segment_rows()

#: The sentences of nested courses, with the stub engine's durations.
COURSE_SENTENCES = f"select doc_id, sent_id as id, raw as text, printf('audio/sent_%04d.wav', sent_id) as audio, round(length(tts) * 0.06::double, 6) as duration_s from ({SENTENCES}) join (select key_id, tts from (with src as (select doc_id * 1000000 + sent_id as doc_id, raw as t from ({SENTENCES})), {NUMBER_WORDS}, {_steps([r[0] for r in RULES])} select doc_id as key_id, t as tts from step_6)) on key_id = doc_id * 1000000 + sent_id"

#: The segments of nested courses: those of sentences with more than one, each with its own spoken text.
COURSE_SEGMENTS = f"with parts as materialized (select *, count(*) over (partition by doc_id, sent_id) as n, (doc_id * 100000 + sent_id) * 1000 + seg_pos as part from ({SEGMENTS})) select p.doc_id, sent_id as id, seg_pos, segment as text, printf('audio/sent_%04d_%02d.wav', sent_id, seg_pos) as audio, round(length(tts) * 0.06::double, 6) as duration_s from parts p join (select doc_id as part, t as tts from (with src as (select part as doc_id, segment as t from parts where n > 1), {NUMBER_WORDS}, {_steps([r[0] for r in RULES])} select doc_id, t from step_{len(RULES)})) using (part) where n > 1"
