"""Fixed values of question reading: cue words, stop lists and patterns, in rule order."""

# Curly quotes and primes, and what each becomes.
SMART_QUOTES = "‘’‚′´“”„″"
PLAIN_QUOTES = "'''''" + '""""'

# Quoted spans. A single quote opens after start, space or '(' and closes before
# end, space or punctuation.
DOUBLE_QUOTED = r'"([^"\n]+)"'
SINGLE_QUOTED = r"(?<![^\s(])'([^'\n]+)'(?![^\s.,;:?!)])"

# Question shapes and qualifiers.
ROOT = r"\broot\b"
HOW_MANY = r"^\s*(?:\W*\w+\s+){0,3}?how\s+many\b"
EXIST_IDIOM = (
    r"\b(?:do|does|did|don't|doesn't|didn't)\s+(?:not\s+)?exist\w*\b|\bnon-?existent\b|"
    r"\bnot\s+exist\w*\b|\binvalid[- ]user\b"
)
NEGATION = (
    r"\b(excluding|exclude|except|without|not|no|none|neither|nor|other than|but not|"
    r"apart from|ignoring|minus|don't|doesn't|didn't|isn't|aren't|wasn't|weren't|can't|"
    r"cannot|couldn't|won't|wouldn't|shouldn't|hasn't|haven't|hadn't|never)\b"
)
LISTING = (
    r"\b(list|listing|lists|show|enumerate|dump|print|display|every|each|per|breakdown|"
    r"grouped?\s+by|rank\w*|histogram|distribution|table of|all of the|all the)\b"
)
ACCOUNT = (
    r"\b(?:for|by|as|of)\s+(?:the\s+)?(?:user|account)\s+([\w.-]+)"
    r"|\bfor\s+(?:the\s+)?([A-Za-z][\w.-]*)\s+(?:user|account)\b"
    r"|\b(?:user|account)\s+named\s+([\w.-]+)"
    r"|\b(?:for|by|as)\s+([A-Za-z][\w.-]{0,31})\b"
)
LITERAL = (
    r"\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[\w-]+(?:\.[\w-]+)+\b|[A-Za-z]:\\\S+|"
    r"(?<!\S)/[\w./-]+|\\\\\S+|\b\d+\b"
)
TIME = (
    r"\b(between|before|after|since|during|until|within|last|first|earliest|latest|recent|"
    r"recently|ago|earlier|later|previous|prior|past|next|upcoming|hours?|minutes?|"
    r"seconds?|days?|weeks?|months?|years?|today|yesterday|tomorrow|tonight|overnight|"
    r"morning|afternoon|evening|night|noon|midnight|o'clock|weekday|weekend|monday|"
    r"tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|may|"
    r"june|july|august|september|october|november|december|timestamp|timestamps|"
    r"time window|over time|per hour|per day|when|while)\b"
)
OTHER_AGGREGATE = (
    r"\b(least|fewest|minimum|bottom|rarest|smallest|lowest|average|mean|median|percent|"
    r"percentage|proportion|share|sum|rate|ratio|deviation|trend|correlat\w*|compar\w*|"
    r"versus|vs|than)\b"
)
OTHER_EVENT = (
    r"\b(disconnect\w*|closed|closes|closing|logout|logged out|log out|timeout|timed out|"
    r"expired|expir\w+|refused|reset|rejected|denied|banned|blocked|locked|kicked|dropped)\b"
)
NETWORK_ZONE = (
    r"\b(outside|inside|internal|external|our network|the network|subnet|netblock|cidr|"
    r"range|vpn|dmz|private|public|corporate|on-?prem\w*|cloud|geo\w*|country|countries)\b"
)
AUTH_METHOD = (
    r"\b(publickey|public[- ]key|password authentication|keyboard[- ]interactive|kerberos|"
    r"gssapi|certificate|hostbased|host[- ]based|two[- ]factor|2fa|mfa|token)\b"
)
FROM = r"\b(?:came\s+|coming\s+|originat\w+\s+)?from\s+(?:the\s+)?([A-Za-z][\w.-]*)\b"
POSSESSIVE = (
    r"\b([A-Za-z][\w.-]*)'s\s+(?:accounts?|sessions?|logins?|attempts?|activity)\b"
    r"|\bunder\s+(?:the\s+)?([A-Za-z][\w.-]*)(?:'s)?\s+(?:accounts?|users?|logins?)\b"
)

# Field and aggregate cues.
IP_CUE = (
    r"\b(ips?|ip address(?:es)?|address(?:es)?|hosts?|rhost|remote[- ]hosts?)\b"
)
USER_CUE = r"\b(user ?names?|account names?|login names?)\b"
EVENT_ID_CUE = r"\b(event ?ids?|event templates?|event types?|templates?)\b"
DISTINCT_CUE = r"\b(distinct|different|unique)\b"
MOST_CUE = r"\b(most|top|commonest|frequent\w*|often)\b"
SOURCE_CUE = r"\bsource\b"
RHOST_CUE = r"\brhost\b|\bremote[- ]hosts?\b"
PLURAL_FIELD = r"\b(ips|addresses|hosts|usernames|users|accounts|templates|event ?ids)\b"

# Plain tests that hold wherever the pattern of that name matches.
ACCOUNT_LEAD = r"\b(?:for|by|as|of)\s|\bnamed\s"
LITERAL_LEAD = r"[\d./\\]"
ROOT_WORDS = ("root",)
HOW_MANY_WORDS = ("many",)
FROM_WORDS = ("from",)
POSSESSIVE_WORDS = ("'s", "under")
MOST_WORDS = ("most", "top", "commonest", "frequent", "often")
CUE_WORDS = {
    "ip": ("ip", "address", "host"),
    "user": ("name",),
    "eid": ("event", "template"),
    "src": ("source",),
    "rhost": ("host",),
    "is_distinct": ("distinct", "different", "unique"),
}

# Words that name a kind of event, in catalog order.
KIND_CUES = {
    "failed_password": (
        "failed password",
        "failed-password",
        "password failure",
        "failed login",
        "wrong password",
    ),
    "invalid_user": (
        "invalid user",
        "invalid-user",
        "nonexistent user",
        "non-existent user",
    ),
    "accepted_login": (
        "accepted",
        "successful login",
        "succeeded",
        "logged in successfully",
        "successful ssh",
    ),
    "possible_break_in": ("break-in", "break in attempt", "breakin"),
    "session_opened": (
        "session opened",
        "sessions opened",
        "opened session",
        "session open",
    ),
    "pam_auth_failure": (
        "authentication failure",
        "authentication-failure",
        "auth failure",
    ),
    "pam_user_unknown": ("user unknown", "check pass"),
}

# Words that are no account name, no origin, no literal.
ACCOUNT_STOP = (
    "the", "a", "an", "this", "that", "these", "those", "its", "it", "which", "what", "how",
    "count", "counts", "number", "source", "destination", "ip", "ips", "address", "addresses",
    "host", "hosts", "user", "users", "username", "usernames", "account", "accounts", "far",
    "well", "much", "many", "most", "least", "all", "any", "each", "every", "one", "per", "of",
    "in", "on", "at", "to", "and", "or", "default", "descending", "ascending", "order",
    "frequency", "name", "names", "type", "types", "event", "events", "line", "lines", "time",
    "date", "template", "templates", "eventid", "sshd", "pam", "failed", "successful", "invalid",
    "accepted", "distinct", "unique", "different", "total", "same", "single", "remote", "local",
    "example", "instance", "reference", "comparison", "sure", "now", "me", "us", "you", "them",
    "him", "her", "attempt", "attempts", "login", "logins", "session", "sessions", "failure",
    "failures", "request", "requests", "connection", "connections", "authentication", "password",
    "passwords", "message", "messages", "log", "logs", "entry", "entries",
)
FROM_STOP = (
    "the", "this", "that", "these", "those", "a", "an", "outside", "inside", "external",
    "internal", "anywhere", "elsewhere", "where", "known", "unknown", "any", "all", "each",
    "every", "log", "logs", "file", "files", "data", "home", "work", "users", "user", "accounts",
    "account", "which", "what", "here", "there", "it", "them", "us", "me", "you", "different",
    "distinct", "same", "other", "another", "multiple", "several", "many", "few", "one", "two",
    "three", "various", "remote", "local", "root", "invalid", "failed", "accepted", "sshd", "pam",
)
ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "cf", "a.m", "p.m", "sshd.auth", "pam_unix.sshd")
