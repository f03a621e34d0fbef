"""Every number and word list that results depend on, in one place. Fixed values, in natural order."""

from __future__ import annotations

from dataclasses import dataclass

#: Words that are never search terms.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")

#: Weights of the fields of a record in ranked search.
FIELD_WEIGHTS = {"title": 3.0, "tags": 2.5, "when": 1.5, "headings": 1.5, "body": 1.0}

#: Weights of the fields in similarity vectors.
VECTOR_WEIGHTS = {"title": 3.0, "tags": 2.5, "body": 1.0}

#: Where lines of an error name the problem.
ERROR_LINE = "(?i)error|fatal|failed|not found|undefined|cannot|no such|invalid|unknown|unrecognized|unexpected|illegal|denied|refused|panicked|no matches"

#: Blocks and lines that tools write into a prompt.
TOOL_BLOCKS = (
    "agent-message", "task-notification", "system-reminder", "bash-input", "bash-stdout", "bash-stderr", "command-message",
    "command-name", "command-args", "local-command-stdout", "local-command-stderr", "local-command-caveat", "pasted_content",
)

#: Roots of paths that name a person or machine.
PATH_ROOTS = ("/home/", "/Users/", "/g/g", "/p/lustre", "/p/vast", "/usr/workspace/", "/scratch/", "/lustre/")

CORRECTION = r"(?i)^(no,\s*(use|it)\b|actually\b|that'?s wrong|that is wrong|don'?t\b|do not\b|stop doing\b|instead\b)"
REMEMBER = r"(?i)\b(remember|note that|keep in mind|don'?t forget)\b"

#: A note that will soon be out of date.
VOLATILE = (
    r"(?i)\b(is at version|at version \d|bumped (to|the version)|released v?\d|now at v?\d|next steps?|todo|in progress|wip|still open|open work"
    r"|\d+ (tests?|items?|lessons?|files?) (pass|passed|left|remain|wait))\b"
)
VOLATILE_MAX_WORDS = 20

#: Programs whose repair teaches nothing.
TRIVIAL_PROGRAMS = ("cd", "ls", "cat", "echo", "grep", "sed", "mkdir", "for", "-c", "&&", "test", "true")


#: The heading that begins a record of each type, and all headings that it needs, in order.
LEAD_HEADINGS = {"pitfall": "Symptom", "recipe": "When to use", "fact": "Statement", "decision": "Decision", "preference": "Rule"}
REQUIRED_HEADINGS = {
    "pitfall": ("Symptom", "Cause", "Fix", "Evidence"),
    "recipe": ("When to use", "Steps", "Evidence"),
    "fact": ("Statement", "Evidence"),
    "decision": ("Context", "Decision", "Why", "Rejected options"),
    "preference": ("Rule", "Why", "How to apply"),
}
STATUS_HEADINGS = {"superseded": "Why superseded", "archived": "Why archived"}
CURRENT = ("active", "stale")
IMAGES = ("png", "jpg", "jpeg", "webp", "svg")
MOST_IMAGE_BYTES = 1 << 20
MOST_QUERIES, MOST_QUERY_CHARS = 8, 200


@dataclass(frozen=True)
class Ranking:
    k1: float = 1.2
    b: float = 0.75
    part_weight: float = 0.5
    expanded_weight: float = 0.5
    expansions: int = 3
    project_boost: float = 1.3
    system_boost: float = 1.15
    expired_factor: float = 0.9
    relative_cut: float = 0.3
    limit: int = 10


@dataclass(frozen=True)
class Similarity:
    terms: int = 64
    stored: float = 0.2
    duplicate: float = 0.4


@dataclass(frozen=True)
class Gates:
    query_terms: int = 40
    line_terms: int = 4
    coverage: float = 0.6
    failure_relevance: float = 0.8
    failure_margin: float = 0.10
    recall_relevance: float = 0.85
    recall_margin: float = 0.10
    triage_keep: float = 0.6
    triage_drop: float = 0.3
    triage_known: float = 0.85
    lesson_lines: int = 150
