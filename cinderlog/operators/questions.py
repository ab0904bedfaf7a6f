"""Reading a table of analyst questions, and checking plans against them.

``read_questions`` adds what a question says: quoted phrases, root scope, cues, and the first
reason why no plan could answer it. ``check_plans`` validates a plan per question. Both are
projections; the reasons are ordered ``CASE`` chains, so the first one that holds wins and later
patterns are not evaluated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import question_words as W
from ..functions.frames import settle
from ..functions.sql import NO_STRINGS, every, first, has, matches, quote, strip, when
from ..functions.text import CI, CS, fold


def _in(value: str, words) -> str:
    return f"{value} IN ({', '.join(quote(w) for w in words)})"


def _groups(col: str, pattern: str, n: int) -> str:
    """Per match the first group that took part, in match order."""
    rest = ", ".join(
        f"nullif(get({every(col, pattern, g)}, i), '')" for g in range(2, n + 1)
    )
    return f"transform({every(col, pattern, 1)}, (a, i) -> coalesce(nullif(a, ''), {rest}))"


def _first_not_in(names: str, stop) -> str:
    return f"get(filter({names}, n -> NOT {_in('lower(n)', stop)}), 0)"


def _some(pattern: str) -> str:
    """First match in the question, NULL without one; most questions stop at the plain tests."""
    hit = first("_q", CI + pattern)
    return when(f"_cued AND {matches('_low', CS + pattern)}", hit)


def _said_anywhere(patterns) -> str:
    """Any of the patterns ``\\b(a|b|...)\\b``, as one whose alternatives are told apart by their first letter.

    A regex engine tries alternatives one after the other; here only those of one letter are left.
    """
    by_letter: dict[str, list[str]] = {}
    for p in patterns:
        inner = p.removeprefix(r"\b(").removesuffix(r")\b")
        if len(inner) != len(p) - 6 or "(" in inner or "[" in inner.replace("[- ]", ""):
            raise ValueError(f"not a plain list of words: {p}")
        for word in inner.split("|"):
            by_letter.setdefault(word[0], []).append(word[1:])
    letters = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items())
    return matches("_low", CS + rf"\b(?:{letters})\b")


def _kinds(hit) -> str:
    return (
        "array_compact(array("
        + ", ".join(when(hit(k, cues), quote(k)) for k, cues in W.KIND_CUES.items())
        + "))"
    )


def _said(before: str, value: str, after: str) -> str:
    return f"concat({quote(before)}, {value}, {quote(after)})"


# Decline rules in order: code, the SQL that is NULL unless the rule applies, and the sentence.
def _declines() -> list[tuple[str, str, str]]:
    negated = "_cued AND " + matches("_low", CS + W.NEGATION) + " AND " + matches(
        f"regexp_replace(_low, {quote(CS + W.EXIST_IDIOM)}, ' ')", CS + W.NEGATION
    )
    account = _first_not_in(
        _groups("_q", CI + W.ACCOUNT, 4), [*dict.fromkeys(W.ACCOUNT_STOP), "root"]
    )
    account = when(matches("_low", CS + W.ACCOUNT_LEAD), account)
    undotted = f"rtrim({quote('.')}, lower(x))"
    literal = (
        f"get(filter({every('_q', CI + W.LITERAL)}, "
        f"x -> NOT {_in(undotted, W.ABBREVIATIONS)}), 0)"
    )
    literal = when(matches("_q", CS + W.LITERAL_LEAD), literal)
    origin = _first_not_in(every("_q", CI + W.FROM, 1), dict.fromkeys(W.FROM_STOP))
    origin = when(has("_low", W.FROM_WORDS), origin)
    owner = _first_not_in(_groups("_q", CI + W.POSSESSIVE, 2), ["root"])
    owner = when(has("_low", W.POSSESSIVE_WORDS), owner)
    plural = (
        f"{has('_low', W.MOST_WORDS)} AND {matches('_low', CS + W.MOST_CUE)} AND {matches('_low', CS + W.PLURAL_FIELD)}"
    )
    # The sentences.
    return [
        (
            "negation",
            when(negated, "''"),
            quote(
                "a negated condition ('except', 'without', 'not', ...) is not representable"
            ),
        ),
        (
            "listing",
            _some(W.LISTING),
            _said(
                "'",
                "_d.hit",
                "' asks for a listing / per-group result; the catalog returns one number or one value",
            ),
        ),
        (
            "account",
            account,
            _said(
                "scoping to account '",
                "_d.hit",
                "' is not representable (only root has a canonical form)",
            ),
        ),
        (
            "literal",
            literal,
            _said(
                "the literal value '",
                "_d.hit",
                "' cannot be applied; quote it to match it as text",
            ),
        ),
        (
            "time",
            _some(W.TIME),
            _said("time scoping ('", "_d.hit", "') is not representable"),
        ),
        (
            "aggregate",
            _some(W.OTHER_AGGREGATE),
            _said(
                "'",
                "_d.hit",
                "' asks for an aggregate or comparison the catalog does not have",
            ),
        ),
        (
            "several_kinds",
            when("size(kinds) > 1", "array_join(kinds, ', ')"),
            _said(
                "the question combines several kinds of event (",
                "_d.hit",
                "); one filter cannot express that",
            ),
        ),
        (
            "event",
            _some(W.OTHER_EVENT),
            _said("'", "_d.hit", "' names an event kind the catalog does not have"),
        ),
        (
            "zone",
            _some(W.NETWORK_ZONE),
            _said("the network scope '", "_d.hit", "' is not representable"),
        ),
        (
            "method",
            _some(W.AUTH_METHOD),
            _said(
                "the authentication method '",
                "_d.hit",
                "' is not a catalog filter; quote the log text to match it",
            ),
        ),
        (
            "origin",
            origin,
            _said(
                "scoping to '",
                "_d.hit",
                "' is not representable; quote a literal value to match it as text",
            ),
        ),
        (
            "possessive",
            owner,
            _said(
                "scoping to account '",
                "_d.hit",
                "' is not representable (only root has a canonical form)",
            ),
        ),
        (
            "plural_most",
            when(plural, "''"),
            quote(
                "a plural field with 'most' asks for several (possibly tied) values; the catalog returns one"
            ),
        ),
    ]


def read_questions(questions: DataFrame) -> DataFrame:
    """Add ``phrases, root_scope, how_many, kinds, decline_code, decline_reason``."""
    columns = questions.columns
    plain = questions.select(
        "*",
        F.translate("question", W.SMART_QUOTES, W.PLAIN_QUOTES).alias("_norm"),
    )
    single = CS + W.SINGLE_QUOTED
    spans = f"concat({every('_norm', W.DOUBLE_QUOTED, 1)}, {every('_norm', single, 1)})"
    without = (
        f"regexp_replace(regexp_replace(_norm, {quote(W.DOUBLE_QUOTED)}, ' '), "
        f"{quote(single)}, ' ')"
    )
    phrases = f"array_distinct(filter(transform({spans}, p -> {strip('p')}), p -> p <> ''))"
    marked = has("_norm", ['"', "'"])
    cut = plain.selectExpr(
        *columns,
        "_norm",
        f"{when(f'_norm IS NULL OR {marked}', phrases, NO_STRINGS)} AS phrases",
        f"{when(marked, without, '_norm')} AS _q",
    )
    # Plain tests on lower-cased copies come first. No letter outside ASCII folds into these words.
    lowered = cut.select("*", fold(F.col("_q")).alias("_low"), F.lower("_norm").alias("_all"))
    lowered = settle(lowered, "phrases", "_q", "_low", "_all")
    asked = [W.NEGATION, W.LISTING, W.TIME, W.OTHER_AGGREGATE, W.OTHER_EVENT]
    asked += [W.NETWORK_ZONE, W.AUTH_METHOD]
    cued = lowered.selectExpr(
        *columns,
        "phrases",
        f"({has('_all', W.ROOT_WORDS)} AND {matches('_norm', CI + W.ROOT)}) AS root_scope",
        f"({has('_all', W.HOW_MANY_WORDS)} AND {matches('question', CI + W.HOW_MANY)}) AS how_many",
        "_q",
        "_low",
        f"{_said_anywhere(asked)} AS _cued",
        f"{_kinds(lambda k, cues: has('_low', cues))} AS kinds",
    )
    chain = " ".join(
        f"WHEN {hit} IS NOT NULL THEN named_struct('code', {quote(code)}, 'hit', {hit})"
        for code, hit, _ in _declines()
    )
    cued = settle(cued, "phrases", "root_scope", "how_many", "_q", "_low", "_cued", "kinds")
    found = settle(cued.selectExpr("*", f"CASE {chain} END AS _d"), "_d")
    sentences = " ".join(
        f"WHEN {quote(code)} THEN {sentence}"
        for code, _, sentence in _declines()
    )
    return found.selectExpr(
        *columns,
        "phrases",
        "root_scope",
        "how_many",
        "kinds",
        "_q AS unquoted",
        "_d.code AS decline_code",
        f"CASE _d.code {sentences} END AS decline_reason",
    )


def decline_report(read: DataFrame) -> DataFrame:
    """Questions per decline code; NULL counts the answerable ones."""
    return read.groupBy("decline_code").agg(F.count("*").alias("n_questions"))


MODEL_KEYS = ("event_filter", "extract_field", "aggregate")
FIELD_CUES = {
    "source_ip": "ip",
    "pam_rhost_ip": "ip",
    "invalid_username": "user",
    "event_id": "eid",
}


def parse_plans(df: DataFrame) -> DataFrame:
    """Add the fields of the ``plan`` JSON and what is wrong with its structure."""
    message = quote("plan keys must be exactly ('event_filter', 'extract_field', 'aggregate')")
    parsed = df.selectExpr("*", "try_parse_json(plan) AS _json")
    usual = ", ".join(f"{n}: STRING" for n in sorted(MODEL_KEYS))
    keys = "array_sort(array_distinct(json_object_keys(plan)))"
    parsed = parsed.selectExpr("*", f"coalesce(schema_of_variant(_json) = 'OBJECT<{usual}>', false) AS _usual")
    # Most plans are what they should be, which their schema tells; the others are taken to pieces.
    parsed = parsed.selectExpr("*", f"{when('NOT _usual', keys)} AS _keys")

    def exact(names) -> str:
        return f"array({', '.join(quote(n) for n in sorted(names))})"

    def kind(name: str) -> str:
        return f"schema_of_variant(try_variant_get(_json, '$.{name}', 'variant'))"

    scoped = [*MODEL_KEYS, "account_scope"]
    texts = " AND ".join(f"coalesce({kind(n)}, '') = 'STRING'" for n in MODEL_KEYS)
    scope = f"coalesce({kind('account_scope')}, 'STRING') = 'STRING'"
    shape = (
        "CASE WHEN _usual THEN NULL WHEN _keys IS NULL THEN 'plan is not an object' "
        f"WHEN _keys <> {exact(MODEL_KEYS)} AND _keys <> {exact(scoped)} THEN {message} "
        f"WHEN NOT ({texts} AND {scope}) THEN 'plan values must be strings' END"
    )
    fields = [f"try_variant_get(_json, '$.{n}', 'string') AS {n}" for n in MODEL_KEYS]
    shaped = parsed.selectExpr(*df.columns, *fields, f"{shape} AS _shape")
    known = " AND ".join(
        [
            _in("event_filter", C.FILTERS),
            _in("extract_field", C.EXTRACTIONS),
            _in("aggregate", C.AGGREGATES),
        ]
    )
    return shaped.selectExpr(
        *df.columns,
        *MODEL_KEYS,
        f"coalesce(_shape, CASE WHEN NOT ({known}) THEN 'value outside the catalog' END) "
        "AS plan_error",
    )


def check_plans(read: DataFrame) -> DataFrame:
    """Validate one plan per read question; ``plan`` is JSON text.

    Adds the normalised plan, ``reason`` (NULL for a valid plan), and for valid plans the literal
    ``words`` of its lines, ``skip_wrappers`` and a plain sentence.
    """
    columns = [c for c in read.columns if c != "plan"]
    plans = parse_plans(read).selectExpr(
        *columns,
        "plan_error",
        "event_filter AS ef",
        "CASE WHEN aggregate = 'count_rows' THEN 'none' ELSE extract_field END AS ex",
        "aggregate AS ag",
    )
    cues = {
        "ip": W.IP_CUE,
        "user": W.USER_CUE,
        "eid": W.EVENT_ID_CUE,
        "src": W.SOURCE_CUE,
        "rhost": W.RHOST_CUE,
        "is_distinct": W.DISTINCT_CUE,
    }

    def named_in_quotes(kind: str, words) -> str:
        every_word = [*words, *[w.lower() for w in C.FILTERS[kind].contains]]
        return f"exists(phrases, p -> {has('lower(p)', every_word)})"

    lowered = plans.select("*", fold(F.col("unquoted")).alias("_low"))

    def cue(name: str, pattern: str) -> str:
        return f"({has('_low', W.CUE_WORDS[name])} AND {matches('_low', CS + pattern)})"

    # What only later reasons look at isn't looked for where an earlier one holds.
    still = "plan_error IS NULL AND decline_reason IS NULL"
    most = f"({has('_low', W.MOST_WORDS)} AND {matches('_low', CS + W.MOST_CUE)} AND NOT how_many)"
    cued = lowered.selectExpr(
        *plans.columns,
        *[f"{when(still, cue(name, p))} AS _{name}" for name, p in cues.items()],
        f"{when(still, most)} AS _most",
        f"{when(still, _kinds(named_in_quotes))} AS _quoted_kinds",
    )
    cued = settle(
        cued,
        *["plan_error", "ef", "ex", "ag"],
        *[f"_{name}" for name in cues],
        *["_most", "_quoted_kinds"],
    )
    checked = cued.selectExpr(
        *columns,
        "ef AS event_filter",
        "ex AS extract_field",
        "ag AS aggregate",
        "CASE WHEN root_scope THEN 'root' ELSE 'any_user' END AS account_scope",
        f"CASE {_plan_chain()} END AS reason",
    )
    checked = settle(checked, "reason")
    valid = "reason IS NULL"
    worded = checked.selectExpr("*", f"{when(valid, _words())} AS words")
    wrapped = f"exists(words, w -> contains(lower(w), {quote(C.WRAPPER)}))"
    skipping = (
        f"(aggregate <> 'count_distinct_values' AND size(words) > 0 AND NOT {wrapped})"
    )
    done = worded.selectExpr("*", f"{when(valid, skipping)} AS skip_wrappers")
    return done.selectExpr("*", f"{when(valid, _sentence())} AS explanation")


def _plan_chain() -> str:
    """Why a plan is refused; first reason wins."""
    rooted = [name for name, f in C.FILTERS.items() if f.root_text]
    field = " ".join(f"WHEN {quote(x)} THEN _{f}" for x, f in FIELD_CUES.items())
    named = f"(CASE ex {field} END)"

    def other(cue: str) -> str:
        same = [x for x, f in FIELD_CUES.items() if f == cue]
        return f"_{cue} AND NOT {_in('ex', same)}"

    others = f"(CASE WHEN {other('ip')} THEN 'ip' WHEN {other('user')} THEN 'user' WHEN {other('eid')} THEN 'eid' END)"
    uncarried = " OR ".join(
        f"ex = {quote(x)} AND NOT {_in('ef', carriers)}"
        for x, carriers in C.CARRIED_BY.items()
    )
    distinct, top = quote(C.AGGREGATES[1]), quote(C.AGGREGATES[2])
    # The sentences.
    rules = [
        ("plan_error IS NOT NULL", "plan_error"),
        (
            "ef = 'quoted_phrase' AND size(phrases) = 0",
            quote("quoted_phrase chosen but the question quotes nothing"),
        ),
        (
            "size(phrases) > 1",
            quote(
                "several quoted phrases: their relationship (and / or) is not representable"
            ),
        ),
        ("decline_reason IS NOT NULL", "decline_reason"),
        (
            f"ag = {top} AND how_many",
            quote("a 'how many' question cannot be a most-frequent-value plan"),
        ),
        (
            "size(kinds) = 1 AND ef <> get(kinds, 0)",
            "concat('the question names ', get(kinds, 0), ' events but the plan chose ', ef)",
        ),
        (
            "size(_quoted_kinds) = 1 AND ef <> get(_quoted_kinds, 0) AND ef <> 'quoted_phrase'",
            "concat('the quoted text names ', get(_quoted_kinds, 0), ' events but the plan chose ', ef)",
        ),
        (
            "ef NOT IN ('all_events', 'quoted_phrase') AND NOT array_contains(kinds, ef) "
            "AND NOT array_contains(_quoted_kinds, ef)",
            "concat('nothing in the question names ', ef, ' events; the plan would be a guess')",
        ),
        (
            f"ex <> 'none' AND {others} IS NOT NULL AND NOT {named}",
            f"concat('the question asks about ', {others}, ' values but the plan extracts ', ex)",
        ),
        (
            f"ex <> 'none' AND NOT {named}",
            _said(
                "the question does not say which field to extract; the plan's ",
                "ex",
                " would be a guess",
            ),
        ),
        (
            "ex = 'source_ip' AND _rhost AND NOT _src",
            quote(
                "the question asks about the rhost= field but the plan extracts the source IP"
            ),
        ),
        (
            "ex = 'pam_rhost_ip' AND _src AND NOT _rhost",
            quote(
                "the question asks about the source IP but the plan extracts the rhost= field"
            ),
        ),
        (
            "ex IN ('source_ip', 'pam_rhost_ip') AND NOT _src AND NOT _rhost",
            quote(
                "'IP' is ambiguous here; say 'source IP' or 'rhost' (the plan's choice would be a guess)"
            ),
        ),
        (
            uncarried,
            "concat(ef, ' lines do not carry ', ex, '; the plan would return nothing')",
        ),
        (
            f"_is_distinct AND ag <> {distinct}",
            quote(
                "the question asks for distinct values but the plan is not a distinct count"
            ),
        ),
        (
            f"_most AND ag <> {top}",
            "concat('the question asks which value is most frequent but the plan is ', "
            "CASE WHEN ag = 'count_rows' THEN 'a plain count' ELSE 'a distinct count' END)",
        ),
        (
            f"ag = {distinct} AND NOT _is_distinct",
            quote(
                "the question does not ask for distinct values; a distinct count would be a guess"
            ),
        ),
        (
            f"ag = {top} AND NOT _most",
            quote(
                "the question does not ask which value is most frequent; a top-value plan would be a guess"
            ),
        ),
        (
            "ag = 'count_rows' AND (_ip OR _user OR _eid)",
            quote(
                "the question names a field (IP / username / EventId); a plain line count would discard it"
            ),
        ),
        (
            f"root_scope AND NOT {_in('ef', rooted)}",
            "concat('the question scopes to root but ', ef, ' has no canonical root form')",
        ),
        (
            "ag <> 'count_rows' AND ex = 'none'",
            "concat(ag, ' needs an extract_field')",
        ),
    ]
    return " ".join(f"WHEN {condition} THEN {reason}" for condition, reason in rules)


def _words() -> str:
    """Literal words of a valid plan's lines: the filter's, refined by the one quoted phrase."""
    rooted = [(n, f.root_text) for n, f in C.FILTERS.items() if f.root_text]
    roots = " ".join(
        f"WHEN account_scope = 'root' AND event_filter = {quote(n)} THEN array({quote(t)})"
        for n, t in rooted
    )
    plain = " ".join(
        f"WHEN event_filter = {quote(n)} THEN array({', '.join(quote(w) for w in f.contains)})"
        for n, f in C.FILTERS.items()
        if f.contains
    )
    base = f"(CASE {roots} {plain} ELSE cast(array() AS array<string>) END)"
    phrase = "get(phrases, 0)"
    implied = f"exists({base}, w -> contains(lower(w), lower({phrase})))"
    refined = (
        f"concat(filter({base}, w -> NOT contains(lower({phrase}), lower(w))), "
        f"array({phrase}))"
    )
    return when(f"size(phrases) = 0 OR {implied}", base, refined)


def _sentence() -> str:
    """What a valid plan computes."""
    labels = " ".join(f"WHEN {quote(n)} THEN {quote(f.label)}" for n, f in C.FILTERS.items())
    nouns = " ".join(
        f"WHEN {quote(n)} THEN {quote(x.noun)}" for n, x in C.EXTRACTIONS.items()
    )
    own = " OR ".join(
        f"event_filter = {quote(n)} AND {_in('get(phrases, 0)', f.contains)}"
        for n, f in C.FILTERS.items()
        if f.contains
    )
    extra = (
        f"(size(phrases) > 0 AND array_contains(words, get(phrases, 0)) AND NOT ({own}))"
    )
    quoted = "concat('\\'', get(phrases, 0), '\\'')"
    what = (
        f"CASE WHEN event_filter = 'quoted_phrase' THEN concat('lines containing ', {quoted}) "
        f"ELSE concat(CASE event_filter {labels} END, "
        "CASE WHEN account_scope = 'root' THEN ' for the root user' ELSE '' END, "
        f"CASE WHEN {extra} THEN concat(' that also contain ', {quoted}) ELSE '' END) END"
    )
    noun = f"CASE extract_field {nouns} END"
    skipped = when(
        "skip_wrappers",
        quote(" (syslog 'message repeated' summary lines are excluded)"),
        "''",
    )
    return (
        f"CASE aggregate WHEN 'count_rows' THEN concat('Counts ', {what}, {skipped}, '.') "
        f"WHEN 'count_distinct_values' THEN concat('Counts how many different ', {noun}, "
        f"'s appear across ', {what}, '.') "
        f"ELSE concat('Finds the ', {noun}, ' that appears most often across ', {what}, "
        f"', and in how many lines', {skipped}, ' (one value; if several tie, the "
        "alphabetically first is shown).') END"
    )
