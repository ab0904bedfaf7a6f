"""Oracle SQL for the question audit and the plan checks, written for DuckDB.

RE2 has no look-around, so quotes and paths are matched with the character next to them and that
character is taken off again.
"""

from __future__ import annotations

from ..functions import catalog as C
from ..functions import question_words as W
from .oracle_triage import lit
from .views import QUESTIONS_SQL

_OPEN, _CLOSE = r"(?:^|[\s(])", r"(?:$|[\s.,;:?!)])"
_SINGLE = _OPEN + r"'([^'\n]+)'" + _CLOSE
_SINGLE_KEEP = r"(^|[\s(])'[^'\n]+'($|[\s.,;:?!)])"
_LITERAL = W.LITERAL.replace(r"(?<!\S)/", r"(?:^|\s)/")


def _i(pattern: str) -> str:
    return lit("(?i)" + pattern)


def _has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {_i(pattern)})"


def _got(pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract(q, {_i(pattern)}, {group}), '')"


def _in(words) -> str:
    return "(" + ", ".join(lit(w) for w in dict.fromkeys(words)) + ")"


def _kinds(hit: str) -> str:
    """Names of the kinds for which ``hit`` (with {cues}) is true."""
    parts = []
    for kind, cues in W.KIND_CUES.items():
        found = " OR ".join(hit.replace("{cue}", lit(c)) for c in cues)
        parts.append(f"CASE WHEN {found} THEN '{kind}' END")
    return f"list_filter([{', '.join(parts)}], lambda k: k IS NOT NULL)"


def _quoted_kinds() -> str:
    parts = []
    for kind, cues in W.KIND_CUES.items():
        words = [*cues, *[w.lower() for w in C.FILTERS[kind].contains]]
        found = " OR ".join(f"contains(lower(p), {lit(w)})" for w in words)
        parts.append(
            f"CASE WHEN len(list_filter(phrases, lambda p: {found})) > 0 THEN '{kind}' END"
        )
    return f"list_filter([{', '.join(parts)}], lambda k: k IS NOT NULL)"


def _account() -> str:
    """Each match of the account pattern, then the name inside it by the same alternatives."""
    alternatives = W.ACCOUNT.split(r"|\b")
    alternatives = [alternatives[0], *[r"\b" + a for a in alternatives[1:]]]
    inner = ", ".join(
        f"nullif(regexp_extract(m, {_i('^(?:' + a + ')$')}, 1), '')" for a in alternatives
    )
    stop = _in([*W.ACCOUNT_STOP, "root"])
    return (
        f"list_filter(list_transform(regexp_extract_all(q, {_i(W.ACCOUNT)}), lambda m: coalesce({inner})), "
        f"lambda n: lower(n) NOT IN {stop})[1]"
    )


def _owner() -> str:
    first, second = W.POSSESSIVE.split(r"|\bunder")
    inner = ", ".join(
        f"nullif(regexp_extract(m, {_i('^(?:' + a + ')$')}, 1), '')"
        for a in (first, r"\bunder" + second)
    )
    return (
        f"list_filter(list_transform(regexp_extract_all(q, {_i(W.POSSESSIVE)}), lambda m: coalesce({inner})), "
        "lambda n: lower(n) <> 'root')[1]"
    )


READ = f"""
WITH raw AS ({QUESTIONS_SQL}),
norm AS (SELECT *, translate(question, {lit(W.SMART_QUOTES)}, {lit(W.PLAIN_QUOTES)}) AS n FROM raw),
cut AS (SELECT *,
 list_filter(list_transform(list_concat(regexp_extract_all(n, {lit(W.DOUBLE_QUOTED)}, 1), regexp_extract_all(n, {lit(_SINGLE)}, 1)),
  lambda p: trim(p)), lambda p: p <> '') AS phrases,
 regexp_replace(regexp_replace(n, {lit(W.DOUBLE_QUOTED)}, ' ', 'g'), {lit(_SINGLE_KEEP)}, '\\1 \\2', 'g') AS q FROM norm),
cued AS (SELECT *, {_has('n', W.ROOT)} AS root_scope, {_has('question', W.HOW_MANY)} AS how_many,
 {_kinds('contains(lower(q), {cue})')} AS kinds FROM cut),
hits AS (SELECT *,
 regexp_matches(regexp_replace(q, {_i(W.EXIST_IDIOM)}, ' ', 'g'), {_i(W.NEGATION)}) AS h1,
 {_got(W.LISTING)} AS h2, {_account()} AS h3,
 list_filter(list_transform(regexp_extract_all(q, {_i(_LITERAL)}), lambda x: trim(x)),
  lambda x: rtrim(lower(x), '.') NOT IN {_in(W.ABBREVIATIONS)})[1] AS h4,
 {_got(W.TIME)} AS h5, {_got(W.OTHER_AGGREGATE)} AS h6, {_got(W.OTHER_EVENT)} AS h8, {_got(W.NETWORK_ZONE)} AS h9,
 {_got(W.AUTH_METHOD)} AS h10,
 list_filter(regexp_extract_all(q, {_i(W.FROM)}, 1), lambda n: lower(n) NOT IN {_in(W.FROM_STOP)})[1] AS h11,
 {_owner()} AS h12, {_has('q', W.MOST_CUE)} AND {_has('q', W.PLURAL_FIELD)} AS h13 FROM cued),
audit AS (SELECT *, CASE WHEN h1 THEN 'negation' WHEN h2 IS NOT NULL THEN 'listing' WHEN h3 IS NOT NULL THEN 'account'
 WHEN h4 IS NOT NULL THEN 'literal' WHEN h5 IS NOT NULL THEN 'time' WHEN h6 IS NOT NULL THEN 'aggregate'
 WHEN len(kinds) > 1 THEN 'several_kinds' WHEN h8 IS NOT NULL THEN 'event' WHEN h9 IS NOT NULL THEN 'zone'
 WHEN h10 IS NOT NULL THEN 'method' WHEN h11 IS NOT NULL THEN 'origin' WHEN h12 IS NOT NULL THEN 'possessive'
 WHEN h13 THEN 'plural_most' END AS decline_code FROM hits),
declined AS (SELECT *, CASE decline_code
 WHEN 'negation' THEN 'a negated condition (''except'', ''without'', ''not'', ...) is not representable'
 WHEN 'listing' THEN '''' || h2 || ''' asks for a listing / per-group result; the catalog returns one number or one value'
 WHEN 'account' THEN 'scoping to account ''' || h3 || ''' is not representable (only root has a canonical form)'
 WHEN 'literal' THEN 'the literal value ''' || h4 || ''' cannot be applied; quote it to match it as text'
 WHEN 'time' THEN 'time scoping (''' || h5 || ''') is not representable'
 WHEN 'aggregate' THEN '''' || h6 || ''' asks for an aggregate or comparison the catalog does not have'
 WHEN 'several_kinds' THEN 'the question combines several kinds of event (' || array_to_string(kinds, ', ') || '); one filter cannot express that'
 WHEN 'event' THEN '''' || h8 || ''' names an event kind the catalog does not have'
 WHEN 'zone' THEN 'the network scope ''' || h9 || ''' is not representable'
 WHEN 'method' THEN 'the authentication method ''' || h10 || ''' is not a catalog filter; quote the log text to match it'
 WHEN 'origin' THEN 'scoping to ''' || h11 || ''' is not representable; quote a literal value to match it as text'
 WHEN 'possessive' THEN 'scoping to account ''' || h12 || ''' is not representable (only root has a canonical form)'
 WHEN 'plural_most' THEN 'a plural field with ''most'' asks for several (possibly tied) values; the catalog returns one'
 END AS decline_reason FROM audit)
"""


def _field(ex: str) -> str:
    return (
        f"CASE {ex} WHEN 'source_ip' THEN c_ip WHEN 'pam_rhost_ip' THEN c_ip "
        "WHEN 'invalid_username' THEN c_user WHEN 'event_id' THEN c_eid END"
    )


_KEYS = "list_sort(json_keys(plan))"
_FORM = f"""
CASE WHEN json_type(plan) <> 'OBJECT' THEN 'plan is not an object'
 WHEN {_KEYS} NOT IN (['aggregate', 'event_filter', 'extract_field'], ['account_scope', 'aggregate', 'event_filter', 'extract_field'])
  THEN 'plan keys must be exactly (''event_filter'', ''extract_field'', ''aggregate'')'
 WHEN json_type(plan, '$.event_filter') <> 'VARCHAR' OR json_type(plan, '$.extract_field') <> 'VARCHAR'
  OR json_type(plan, '$.aggregate') <> 'VARCHAR' THEN 'plan values must be strings'
 WHEN plan->>'$.event_filter' NOT IN {_in(C.FILTERS)} OR plan->>'$.extract_field' NOT IN {_in(C.EXTRACTIONS)}
  OR plan->>'$.aggregate' NOT IN {_in(C.AGGREGATES)} THEN 'value outside the catalog' END
"""
_CARRY = " OR ".join(
    f"ex = '{x}' AND ef NOT IN {_in(names)}" for x, names in C.CARRIED_BY.items()
)
_LABELS = " ".join(f"WHEN '{n}' THEN {lit(f.label)}" for n, f in C.FILTERS.items())
_NOUNS = " ".join(f"WHEN '{n}' THEN {lit(x.noun)}" for n, x in C.EXTRACTIONS.items())
_WORD = " ".join(
    f"WHEN '{n}' THEN {lit(f.contains[0])}" for n, f in C.FILTERS.items() if f.contains
)

CHECK = f"""{READ},
parsed AS (SELECT * REPLACE (CASE WHEN json_valid(plan) THEN plan ELSE '[]' END AS plan) FROM declined),
formed AS (SELECT *, {_FORM} AS form FROM parsed),
plans AS (SELECT *, CASE WHEN form IS NULL OR form = 'value outside the catalog' THEN plan->>'$.event_filter' END AS ef,
 CASE WHEN form IS NULL OR form = 'value outside the catalog' THEN
  CASE WHEN plan->>'$.aggregate' = 'count_rows' THEN 'none' ELSE plan->>'$.extract_field' END END AS ex,
 CASE WHEN form IS NULL OR form = 'value outside the catalog' THEN plan->>'$.aggregate' END AS ag,
 {_has('lower(q)', W.IP_CUE)} AS c_ip, {_has('lower(q)', W.USER_CUE)} AS c_user, {_has('lower(q)', W.EVENT_ID_CUE)} AS c_eid,
 {_has('lower(q)', W.SOURCE_CUE)} AS c_src, {_has('lower(q)', W.RHOST_CUE)} AS c_rhost, {_has('lower(q)', W.DISTINCT_CUE)} AS c_distinct,
 {_has('lower(q)', W.MOST_CUE)} AND NOT how_many AS c_most, {_quoted_kinds()} AS qk FROM formed),
fields AS (SELECT *, {_field('ex')} AS named,
 CASE WHEN c_ip AND ex NOT IN ('source_ip', 'pam_rhost_ip') THEN 'ip' WHEN c_user AND ex <> 'invalid_username' THEN 'user'
  WHEN c_eid AND ex <> 'event_id' THEN 'eid' END AS other FROM plans),
checked AS (SELECT *, CASE WHEN form IS NOT NULL THEN form
 WHEN ef = 'quoted_phrase' AND len(phrases) = 0 THEN 'quoted_phrase chosen but the question quotes nothing'
 WHEN len(phrases) > 1 THEN 'several quoted phrases: their relationship (and / or) is not representable'
 WHEN decline_reason IS NOT NULL THEN decline_reason
 WHEN ag = 'most_frequent_value_and_count' AND how_many THEN 'a ''how many'' question cannot be a most-frequent-value plan'
 WHEN len(kinds) = 1 AND ef <> kinds[1] THEN 'the question names ' || kinds[1] || ' events but the plan chose ' || ef
 WHEN len(qk) = 1 AND ef <> qk[1] AND ef <> 'quoted_phrase' THEN 'the quoted text names ' || qk[1] || ' events but the plan chose ' || ef
 WHEN ef NOT IN ('all_events', 'quoted_phrase') AND NOT list_contains(kinds, ef) AND NOT list_contains(qk, ef)
  THEN 'nothing in the question names ' || ef || ' events; the plan would be a guess'
 WHEN ex <> 'none' AND other IS NOT NULL AND NOT named THEN 'the question asks about ' || other || ' values but the plan extracts ' || ex
 WHEN ex <> 'none' AND NOT named THEN 'the question does not say which field to extract; the plan''s ' || ex || ' would be a guess'
 WHEN ex = 'source_ip' AND c_rhost AND NOT c_src THEN 'the question asks about the rhost= field but the plan extracts the source IP'
 WHEN ex = 'pam_rhost_ip' AND c_src AND NOT c_rhost THEN 'the question asks about the source IP but the plan extracts the rhost= field'
 WHEN ex IN ('source_ip', 'pam_rhost_ip') AND NOT c_src AND NOT c_rhost
  THEN '''IP'' is ambiguous here; say ''source IP'' or ''rhost'' (the plan''s choice would be a guess)'
 WHEN {_CARRY} THEN ef || ' lines do not carry ' || ex || '; the plan would return nothing'
 WHEN c_distinct AND ag <> 'count_distinct_values' THEN 'the question asks for distinct values but the plan is not a distinct count'
 WHEN c_most AND ag = 'count_rows' THEN 'the question asks which value is most frequent but the plan is a plain count'
 WHEN c_most AND ag = 'count_distinct_values' THEN 'the question asks which value is most frequent but the plan is a distinct count'
 WHEN ag = 'count_distinct_values' AND NOT c_distinct THEN 'the question does not ask for distinct values; a distinct count would be a guess'
 WHEN ag = 'most_frequent_value_and_count' AND NOT c_most
  THEN 'the question does not ask which value is most frequent; a top-value plan would be a guess'
 WHEN ag = 'count_rows' AND (c_ip OR c_user OR c_eid)
  THEN 'the question names a field (IP / username / EventId); a plain line count would discard it'
 WHEN root_scope AND ef <> 'session_opened' THEN 'the question scopes to root but ' || ef || ' has no canonical root form'
 WHEN ag <> 'count_rows' AND ex = 'none' THEN ag || ' needs an extract_field' END AS reason FROM fields),
based AS (SELECT *, phrases[1] AS p, CASE WHEN root_scope AND ef = 'session_opened' THEN 'session opened for user root'
 ELSE CASE ef {_WORD} END END AS base FROM checked),
worded AS (SELECT *, CASE WHEN reason IS NOT NULL THEN NULL WHEN p IS NULL THEN coalesce(base, '')
 WHEN base IS NULL THEN p WHEN contains(lower(base), lower(p)) THEN base WHEN contains(lower(p), lower(base)) THEN p
 ELSE base || '|' || p END AS words FROM based),
skipped AS (SELECT *, CASE WHEN reason IS NULL THEN ag <> 'count_distinct_values' AND words <> ''
 AND NOT contains(lower(words), 'message repeated') END AS skip_wrappers FROM worded),
said AS (SELECT *, CASE WHEN ef = 'quoted_phrase' THEN 'lines containing ''' || p || ''''
 ELSE CASE ef {_LABELS} END || CASE WHEN root_scope THEN ' for the root user' ELSE '' END ||
  CASE WHEN p IS NOT NULL AND list_contains(string_split(words, '|'), p) AND p <> coalesce(CASE ef {_WORD} END, '')
   THEN ' that also contain ''' || p || '''' ELSE '' END END AS what,
 CASE ex {_NOUNS} END AS noun,
 CASE WHEN skip_wrappers THEN ' (syslog ''message repeated'' summary lines are excluded)' ELSE '' END AS excl FROM skipped),
done AS (SELECT *, CASE WHEN reason IS NOT NULL THEN NULL WHEN ag = 'count_rows' THEN 'Counts ' || what || excl || '.'
 WHEN ag = 'count_distinct_values' THEN 'Counts how many different ' || noun || 's appear across ' || what || '.'
 ELSE 'Finds the ' || noun || ' that appears most often across ' || what || ', and in how many lines' || excl ||
  ' (one value; if several tie, the alphabetically first is shown).' END AS explanation FROM said)
"""


def question_oracles(mixed: str, scan: str, values: dict[str, str]) -> dict[str, str]:
    extract = " ".join(f"WHEN '{x}' THEN {sql}" for x, sql in values.items())
    valid = "reason IS NULL"
    gate = (
        f", scan AS (SELECT artifact_id, family, present, has_ipv6 FROM ({scan}) s), "
        "gated AS (SELECT artifact_id, question_id, ef AS event_filter, ex AS extract_field, "
        "CASE WHEN family IS NULL THEN 'no intent catalog for this artifact''s layout' "
        "WHEN NOT list_contains(string_split(present, ','), ef) THEN 'the artifact contains no ''' || ef || ''' lines' "
        "WHEN has_ipv6 AND ex IN ('source_ip', 'pam_rhost_ip') "
        "THEN 'the artifact carries IPv6 addresses, which the catalog''s IPv4 extractors would miss' END AS artifact_reason "
        "FROM done LEFT JOIN scan USING (artifact_id) WHERE reason IS NULL)"
    )
    why = "(SELECT artifact_reason FROM gated g WHERE g.question_id = a.question_id)"

    def gated(answers: str) -> str:
        """Answers without the numbers of questions that an artifact cannot answer."""
        shown = f"CASE WHEN {why} IS NULL THEN"
        return f"SELECT a.* REPLACE ({shown} c END AS c), {why} AS reason FROM ({answers}) a"

    return {
        "question_audit": f"{READ} SELECT question_id, array_to_string(phrases, '|') AS phrases, root_scope, how_many, "
        "array_to_string(kinds, ',') AS kinds, q AS unquoted, decline_code, decline_reason FROM declined",
        "decline_report": f"{READ} SELECT decline_code, count(*) AS n_questions FROM declined GROUP BY 1",
        "plan_check": f"{CHECK} SELECT question_id, reason, CASE WHEN {valid} THEN ef END AS event_filter, "
        f"CASE WHEN {valid} THEN ex END AS extract_field, "
        f"CASE WHEN {valid} THEN CASE WHEN root_scope THEN 'root' ELSE 'any_user' END END AS account_scope, "
        "words, skip_wrappers, explanation FROM done",
        "plan_restrict": f"{CHECK}{gate} SELECT artifact_id, question_id, event_filter, extract_field, artifact_reason FROM gated",
        "phrase_answers": f"{CHECK}{gate}, logs AS (SELECT artifact_id, Content FROM {mixed}), "
        "asked AS (SELECT DISTINCT artifact_id, words, skip_wrappers FROM done WHERE reason IS NULL AND ag = 'count_rows' AND NOT root_scope), "
        "counted AS (SELECT artifact_id, words, skip_wrappers, count(*) AS c FROM asked JOIN logs USING (artifact_id) "
        "WHERE (words = '' OR len(list_filter(string_split(words, '|'), lambda w: NOT contains(Content, w))) = 0) "
        "AND NOT (skip_wrappers AND contains(Content, 'message repeated')) GROUP BY 1, 2, 3) "
        + gated(
            "SELECT artifact_id, question_id, coalesce(c, 0) AS c FROM done LEFT JOIN counted USING (artifact_id, words, skip_wrappers) "
            "WHERE reason IS NULL AND ag = 'count_rows' AND NOT root_scope"
        ),
        "question_answers": f"{CHECK}{gate}, logs AS (SELECT artifact_id, Content, EventId FROM {mixed}), "
        "wanted AS (SELECT * FROM done WHERE reason IS NULL), "
        f"lines AS (SELECT question_id, w.ag, CASE ex {extract} END AS v, ex FROM wanted w JOIN logs USING (artifact_id) "
        "WHERE (words = '' OR len(list_filter(string_split(words, '|'), lambda t: NOT CASE WHEN root_scope AND t = 'session opened for user root' "
        "THEN regexp_matches(Content, 'session opened for user root(\\s|$)') ELSE contains(Content, t) END)) = 0) "
        "AND NOT (skip_wrappers AND contains(Content, 'message repeated'))), "
        "kept AS (SELECT * FROM lines WHERE ex IN ('none', 'event_id') OR v <> ''), "
        "top AS (SELECT question_id, v, c FROM (SELECT question_id, v, count(*) AS c, row_number() OVER "
        "(PARTITION BY question_id ORDER BY count(*) DESC, v NULLS LAST) AS r FROM kept "
        "WHERE ag = 'most_frequent_value_and_count' GROUP BY 1, 2) q WHERE r = 1), "
        "counts AS (SELECT question_id, count(*) AS n, count(DISTINCT v) AS d FROM kept GROUP BY 1) "
        + gated(
            "SELECT artifact_id, question_id, top.v AS v, CASE ag WHEN 'count_rows' THEN coalesce(counts.n, 0) "
            "WHEN 'count_distinct_values' THEN coalesce(counts.d, 0) ELSE top.c END AS c FROM wanted LEFT JOIN counts USING (question_id) "
            "LEFT JOIN top USING (question_id)"
        ).replace("REPLACE (", f"REPLACE (CASE WHEN {why} IS NULL THEN v END AS v, "),
    }
