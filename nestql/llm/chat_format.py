"""Chat formatting with a grammar that reads its own output back.

A conversation is a sequence of turns, each rendered between its role's markers. Rendered text is reparsed
by a deterministic parser; where what comes back differs from the source, the control strings in the
turn's text are escaped, again until it is identical. Escaping puts a backslash behind a control string's
first character (`<\\/s>`), or one more where there are some already, so no control string is left in a
text and taking one backslash away restores it exactly.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Opening and closing marker of known roles; `other` holds any further role's name between its markers.

    A turn whose text is escaped has `escaped` behind its opening marker.
    """

    roles: tuple[tuple[str, str, str], ...] = (
        ("system", "<s>[SYS] ", " [/SYS]"),
        ("user", "<s>[INST] ", " [/INST]"),
        ("assistant", "<s>[ANS] ", " </s>"),
    )
    other: tuple[str, str, str] = ("<s>[TURN ", "] ", " [/TURN]")
    escaped: str = "[ESC] "
    learn: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        marks = [x.strip() for _, a, b in self.roles for x in (a, b)] + [self.other[0].strip(), self.other[2].strip(), self.escaped.strip()]
        pieces = {p for m in marks for p in re.findall(r"<[^>]*>|\[[^\]]*\]?", m)}
        return sorted(pieces, key=lambda p: (-len(p), p))


class Grammar:
    """Renders turns and parses what it rendered."""

    def __init__(self, template: Template = Template()):
        self.template = template
        tails = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in template.controls())
        self._control = re.compile(f"(?:{tails})")
        self._plain = re.compile("|".join(re.escape(c) for c in template.controls()))
        self._roles = {r: (a, b) for r, a, b in template.roles}
        self._longest = max(len(m) for m in [template.other[0], *(m for _, m, _ in template.roles)])

    def escape(self, text: str) -> str:
        return self._control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._control.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)

    def _markers(self, role: str) -> tuple[str, str]:
        if role in self._roles:
            return self._roles[role]
        a, b, close = self.template.other
        return a + self.escape(role).replace("%", "%25").replace("]", "%5D") + b, close

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """(rendered turn, start, end of its text): plain if that reads back the same, else escaped."""
        before, after = self._markers(role)
        body = text
        for mark in ("", self.template.escaped):
            head = before + mark
            out = head + body + after
            if self._reads_back(out, role, text):
                return out, len(head), len(head) + len(body)
            body = self.escape(text)
        raise AssertionError("an escaped turn always reads back")

    def _reads_back(self, rendered: str, role: str, text: str) -> bool:
        try:
            turns = list(self.parse(rendered))
        except ValueError:
            return False
        # a control string left in the text would be one to whatever reads it next
        return len(turns) == 1 and turns[0][:2] == (role, text) and not self._plain.search(rendered[turns[0][2] : turns[0][3]])

    def parse(self, rendered: str):
        """(role, text, start, end) of each turn, or ValueError where the text is none of the grammar's."""
        reader = Reader(self)
        yield from ((role, text, start, end) for role, text, start, end, _ in reader.feed(rendered))
        reader.finish()

    def opening(self, buffer: str, at: int) -> tuple[str, int, str] | None:
        """(role, where its turn's text or mark begins, closing marker); None if the buffer ends too early to tell."""
        for role, a, b in self.template.roles:
            if buffer.startswith(a, at):
                return role, at + len(a), b
        a, b, close = self.template.other
        rest = buffer[at : at + self._longest]
        if buffer.startswith(a, at):
            end = buffer.find(b, at)
            if end < 0:
                return None
            role = self.unescape(buffer[at + len(a) : end].replace("%5D", "]").replace("%25", "%"))
            return role, end + len(b), close
        if any(m.startswith(rest) for m in [a, *(m for _, m, _ in self.template.roles)]):
            return None
        raise ValueError(f"no turn begins at {at}")


class Reader:
    """Parses a formatted conversation that comes in parts, however it is cut; holds no more than a part and an open turn."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.buffer, self.before, self.looked = grammar, "", 0, 0

    def feed(self, part: str):
        """(role, text, start, end, raw text) of each turn that this part completes; places are those in the whole conversation."""
        self.buffer += part
        g, at, buffer = self.grammar, 0, self.buffer
        while at < len(buffer):
            found = g.opening(buffer, at)
            if found is None:
                break
            role, begin, close = found
            end = buffer.find(close, max(begin, self.looked))
            if end < 0:
                self.looked = max(begin, len(buffer) - len(close) + 1) - at
                break
            self.looked = 0
            escaped = buffer.startswith(g.template.escaped, begin)
            begin += len(g.template.escaped) if escaped else 0
            if end < begin:
                raise ValueError(f"the turn at {self.before + at} ends in its mark")
            raw = buffer[begin:end]
            yield role, g.unescape(raw) if escaped else raw, self.before + begin, self.before + end, raw
            at = end + len(close)
        self.buffer, self.before = buffer[at:], self.before + at

    def finish(self) -> None:
        if self.buffer:
            raise ValueError(f"the turn at {self.before} does not end")


_FORMATTED = "conv_id long, turn long, role string, rendered string, text_start long, text_end long, learnt boolean, escaped_text string"


def format_turns(
    conversations: DataFrame,
    template: Template = Template(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row (conv_id, turn, role, rendered, text_start, text_end, learnt, escaped_text) for each row, in no order.

    A conversation is its rendered turns in the order of `in_order`. The turn's text stands from text_start to text_end, in characters of
    `rendered`, and is under the loss mask if `learnt`; `escaped_text` is the text itself where it had to be escaped, else null.
    Null texts and roles are empty ones; rows without a conversation id form one conversation of their own. Rows are
    rendered one by one, so repeats stay repeats and nothing is shuffled. Other columns are ignored.
    """

    def run(batches):
        grammar = Grammar(template)
        for batch in batches:
            rendered, start, end, escaped = [], [], [], []
            roles = batch.column(2).to_pylist()
            for role, text in zip(roles, batch.column(3).to_pylist(), strict=True):
                out, a, b = grammar.render(role, text)
                rendered.append(out)
                start.append(a)
                end.append(b)
                escaped.append(None if b - a == len(text) else text)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(rendered, pa.string()),
                    pa.array(start, pa.int64()),
                    pa.array(end, pa.int64()),
                    pa.array([r in template.learn for r in roles], pa.bool_()),
                    pa.array(escaped, pa.string()),
                ],
                ["conv_id", "turn", "role", "rendered", "text_start", "text_end", "learnt", "escaped_text"],
            )

    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, _FORMATTED)


def in_order(formatted: DataFrame) -> DataFrame:
    """Each conversation's turns together in one partition, by number; turns of equal number by role, then text."""
    text = F.coalesce("escaped_text", F.substr("rendered", F.col("text_start") + 1, F.col("text_end") - F.col("text_start")))
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", text)


class _Digest:
    def __init__(self, conv, grammar: Grammar):
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.reader = Reader(grammar)

    def read(self, part: str, mask: dict[int, int]) -> None:
        """Take the next part of the conversation; `mask` has the ends of its spans under the loss mask by their starts."""
        self.chars += len(part)
        for role, text, start, end, _ in self.reader.feed(part):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if start in mask:
                if mask.pop(start) != end:
                    raise ValueError(f"the loss mask and the turn at {start} of conversation {self.conv} differ")
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self):
        self.reader.finish()
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each conversation of format_turns' rows: what the parser reads back from the whole formatted conversation.

    Rendered turns are put in order and joined, and the grammar alone finds the turns in what comes out; spans of the loss
    mask must be texts that it found. A conversation streams through its task part by part, so its length is not bounded
    by memory; its digests are over one sequence of bytes and so are not spread over tasks. Rendering is: it comes before the shuffle.
    """

    def run(batches):
        grammar, now = Grammar(template), None

        def table(rows):
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            done = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for conv, rows in groupby(zip(*columns, strict=True), lambda r: r[0]):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv, grammar)
                parts, mask, at = [], {}, now.chars
                for _, rendered, start, end, learnt in rows:
                    parts.append(rendered)
                    if learnt:
                        mask[at + start] = at + end
                    at += len(rendered)
                now.read("".join(parts), mask)
                if mask:
                    raise ValueError(f"the loss mask of conversation {conv} covers what is no turn's text")
            yield table(done)
        if now is not None:
            yield table([now.row()])

    return in_order(formatted).select("conv_id", "rendered", "text_start", "text_end", "learnt").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
