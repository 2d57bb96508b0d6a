"""The inspection language: one line of text to an instruction, and an instruction to a DataFrame.

Keywords are in any case, and ``;`` and ``,`` at the end of a word do not count. ``FROM name`` is accepted and ignored.
A clause's keyword without a number after it is passed over, a ``*`` beside names is dropped, and a column named like a
clause cannot be selected. Text that is no command gives an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from laminar.operators import metadata
from laminar.table import ColTable

DEFAULT_LIMIT = 20
_CLAUSES = ("LIMIT", "OFFSET", "STRIPE", "FROM")


class DslError(ValueError):
    """Text that is no command, or a command on what is not there."""


@dataclass
class Instruction:
    """What to do, and with what."""

    op: str
    columns: list[str] = field(default_factory=list)
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    stripe: int | None = None
    stream: int | None = None
    top: int | None = None


def tokenize(text: str) -> list[str]:
    words = (w.rstrip(";,") for part in text.split() for w in part.replace(",", ", ").split())
    return [w for w in words if w]


def _number(words: list[str], at: int) -> int | None:
    return int(words[at]) if at < len(words) and words[at].isdigit() else None


def compile_text(text: str) -> Instruction:
    words = tokenize(text)
    if not words:
        raise DslError("nothing to do")
    verb = words[0].upper()
    if verb == "SELECT":
        return _select(words[1:])
    if verb in ("DESCRIBE", "DESC"):
        return Instruction("describe")
    if verb == "HELP":
        return Instruction("help")
    if verb in ("QUIT", "EXIT"):
        return Instruction("quit")
    if verb == "SHOW":
        return _show(words[1:])
    raise DslError(f"unknown command {words[0]!r}")


def _select(words: list[str]) -> Instruction:
    out, at = Instruction("select"), 0
    while at < len(words):
        upper = words[at].upper()
        if upper in _CLAUSES:
            if upper == "FROM":
                at += 2
                continue
            value = _number(words, at + 1)
            if value is not None:
                setattr(out, upper.lower(), value)
                at += 1
        elif words[at] != "*":
            out.columns.append(words[at])
        at += 1
    return out


def _show(words: list[str]) -> Instruction:
    upper = [w.upper() for w in words]
    two = " ".join(upper[:2])
    names = {"FILE LAYOUT": "layout", "STRIPES METADATA": "stripes_metadata", "STRIPE GROUPS": "stripe_groups", "OPTIONAL SECTIONS": "sections"}
    if two in names:
        return Instruction(names[two])
    if not upper or upper[0] not in ("SCHEMA", "INFO", "STATS", "STRIPES", "STREAMS", "ENCODING", "INDEX", "HISTOGRAM", "CONTENT"):
        raise DslError(f"unknown: SHOW {' '.join(words)}")
    out = Instruction(upper[0].lower())
    if out.op == "content":
        out.stream = _number(words, 1)
        if out.stream is None:
            raise DslError("SHOW CONTENT needs a stream's number")
    for i, w in enumerate(upper):
        if w == "STRIPE":
            out.stripe = _number(words, i + 1)
        elif w == "TOP":
            out.top = _number(words, i + 1)
    return out


HELP = (
    "SELECT columns|* [FROM t] [LIMIT n] [OFFSET n] [STRIPE s]", "DESCRIBE", "SHOW SCHEMA", "SHOW INFO", "SHOW STATS", "SHOW STRIPES",
    "SHOW STREAMS [STRIPE s]", "SHOW ENCODING [STRIPE s]", "SHOW INDEX", "SHOW HISTOGRAM [TOP n] [STRIPE s]",
    "SHOW CONTENT stream [STRIPE s]", "SHOW FILE LAYOUT", "SHOW STRIPES METADATA", "SHOW STRIPE GROUPS", "SHOW OPTIONAL SECTIONS",
    "HELP", "QUIT",
)


def execute(t: ColTable, x: Instruction) -> DataFrame | None:
    """The instruction's rows; None for QUIT."""
    if x.op == "quit":
        return None
    if x.op == "help":
        return t.held.sparkSession.createDataFrame([(h,) for h in HELP], "command string")
    if x.stripe is not None and not 0 <= x.stripe < t.n_stripes:
        raise DslError(f"stripe {x.stripe} is not among {t.n_stripes}")
    if x.op == "select":
        try:
            return t.select(x.columns, x.limit, x.offset, x.stripe)
        except KeyError as e:
            raise DslError(e.args[0]) from None
    if x.op in ("streams", "encoding", "histogram", "content"):
        return getattr(metadata, x.op)(t, x)
    return metadata.stats_of(t) if x.op == "stats" else getattr(metadata, x.op)(t)


def run(t: ColTable, text: str) -> DataFrame | None:
    return execute(t, compile_text(text))
