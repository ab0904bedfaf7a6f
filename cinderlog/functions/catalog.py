"""The auth-log catalog: which lines, which value, which aggregate.

Entries are data; ``predicates.py`` and ``answers.py`` compile them to Columns. Adding an entry
here is all it takes to add a filter or an extraction.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LineFilter:
    contains: tuple[str, ...]
    label: str
    root_text: str | None = None


@dataclass(frozen=True)
class Extraction:
    noun: str
    pattern: str | None = None
    column: str | None = None


# Family name, text column, required header, marker texts.
FAMILY = "loghub_auth"
TEXT = "Content"
REQUIRED_COLUMNS = ("LineId", "Content", "EventId", "EventTemplate")
MARKERS = (
    "sshd",
    "pam_unix",
    "Failed password",
    "Invalid user ",
    "POSSIBLE BREAK-IN ATTEMPT",
    "rhost=",
    "logname=",
    "session opened for user",
    "check pass; user unknown",
)
WRAPPER = "message repeated"

# The nine line filters.
FILTERS = {
    "all_events": LineFilter((), "all log lines"),
    "failed_password": LineFilter(
        ("Failed password",), "lines recording a failed SSH password attempt"
    ),
    "invalid_user": LineFilter(
        ("Invalid user ",),
        "lines recording a login attempt for a non-existent (invalid) user",
    ),
    "accepted_login": LineFilter(
        ("Accepted ",), "lines recording a successful SSH login"
    ),
    "possible_break_in": LineFilter(
        ("POSSIBLE BREAK-IN ATTEMPT",),
        "lines sshd flagged as POSSIBLE BREAK-IN ATTEMPT",
    ),
    "session_opened": LineFilter(
        ("session opened",),
        "lines recording a PAM session being opened",
        root_text="session opened for user root",
    ),
    "pam_auth_failure": LineFilter(
        ("authentication failure",), "lines recording a PAM authentication failure"
    ),
    "pam_user_unknown": LineFilter(
        ("user unknown",), "lines recording a PAM 'user unknown' probe"
    ),
    "quoted_phrase": LineFilter((), "lines containing the quoted text"),
}

# The five extractions.
EXTRACTIONS = {
    "none": Extraction("line"),
    "source_ip": Extraction("source IP address", pattern=r"(\d+\.\d+\.\d+\.\d+)"),
    "pam_rhost_ip": Extraction(
        "remote host (rhost=) IP address", pattern=r"rhost=(\d+\.\d+\.\d+\.\d+)"
    ),
    "invalid_username": Extraction(
        "invalid username", pattern=r"Invalid user\s+(\S+)"
    ),
    "event_id": Extraction("event template (EventId)", column="EventId"),
}

# Aggregates, account scopes, and the filters whose lines carry a field.
AGGREGATES = ("count_rows", "count_distinct_values", "most_frequent_value_and_count")
SCOPES = ("any_user", "root")
CARRIED_BY = {
    "source_ip": (
        "all_events",
        "failed_password",
        "invalid_user",
        "accepted_login",
        "possible_break_in",
        "pam_auth_failure",
        "quoted_phrase",
    ),
    "pam_rhost_ip": ("all_events", "pam_auth_failure", "quoted_phrase"),
    "invalid_username": ("all_events", "invalid_user", "quoted_phrase"),
}

# IPv6 look of a message (address-like group, its first occurrence, a hex letter).
IPV6_SHAPE = (
    r"(?i)(?:^|[^0-9a-f:])(?:[0-9a-f]{1,4}:){2,}[0-9a-f]{1,4}(?:$|[^0-9a-f:])"
)
IPV6_FIRST = r"(?i)(?:[0-9a-f]{1,4}:){2,}[0-9a-f]{1,4}"
IPV6_LETTER = r"(?i)[a-f]"

VOCABULARY = tuple(name for name, f in FILTERS.items() if f.contains)
