"""Chat formatting: roles of a transcript's lines by a hidden Markov model.

A transcript is plain text: lines of several speakers, with or without marks
such as ``User:``. The hidden states are (role, first line of a turn) and
(role, later line); a line shows a few features: the mark that it begins with,
whether blank lines stand before it, its length class, whether it asks, how it
begins. Start, step and feature weights are counted on labelled conversations
(in Spark; the driver gets one row per state and feature value) and smoothed;
marks get a prior so that they work where training data has none. Viterbi
finds the likeliest states, turns begin at first-line states, and every turn is
rendered as ``<|role|>``, its text without the mark, ``<|end|>``.

Edge cases: a null or blank text has no turns and renders as the empty text;
unknown, null roles are not learned from; repeated turns are lines like
others; turns of one number are ordered by role and text; a null conv_id is a
conversation of its own for every row; conversations of more than
``PIECE_TURNS`` turn numbers are parsed piece by piece (each a transcript), so
no task gathers an unbounded one; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
PIECE_TURNS = 5_000
SMOOTH = 0.5
MARK_PRIOR = 50.0
POOLED = 200.0

# Speaker marks and the roles they stand for.
MARKS = {
    "system": "system", "instructions": "system",
    "user": "user", "human": "user", "customer": "user", "question": "user", "q": "user", "me": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "agent": "assistant", "answer": "assistant",
    "a": "assistant", "gpt": "assistant", "model": "assistant",
}
_MARK = re.compile(rf"^\s*(?:<\|?|\[|\*\*|#+\s*)?({'|'.join(sorted(MARKS, key=len, reverse=True))})(?:\|?>|\]|\*\*)?\s*(?::|>|(?<=>)|(?<=\])|-\s)(?:\*\*)?\s*",
                   re.IGNORECASE)
FEATURES = ("mark", "gap", "length", "asks", "begins")
SIZES = (len(ROLES) + 1, 3, 12, 2, 4)
STATES = 2 * len(ROLES)  # role * 2 + (0 first line, 1 later line)


def split_lines(text: str | None) -> tuple[list[str], list[bool]]:
    """The lines that are not blank, and whether blank ones stand before."""
    lines, gaps, gap = [], [], True
    for line in (text or "").splitlines():
        if line.strip():
            lines.append(line)
            gaps.append(gap)
            gap = False
        else:
            gap = True
    return lines, gaps


def line_features(line: str, gap: bool) -> tuple[int, ...]:
    m = _MARK.match(line)
    mark = ROLES.index(MARKS[m[1].lower()]) + 1 if m else 0
    body = line[m.end():] if m else line
    first = body.lstrip()[:1]
    begins = 0 if first.isupper() else 1 if first.islower() else 2 if first in "-*0123456789`#>" and first else 3
    return mark, 2 if mark else int(gap), min(11, len(body).bit_length()), int(body.rstrip().endswith("?")), begins


class Hmm:
    """Log weights: start, step, and per feature state by value."""

    def __init__(self, counts: dict[tuple[str, int, int], float]):
        def table(kind: str, rows: int, cols: int) -> np.ndarray:
            t = np.full((rows, cols), SMOOTH)
            for (k, i, j), n in counts.items():
                if k == kind:
                    t[i, j] += n
            return t

        # A mark says most of what can be said, however few the data have;
        # a marked line needs no blank line before it.
        plain = {s: counts.get(("mark", s, 0), 0) + MARK_PRIOR for s in range(STATES)}
        prior = {("mark", 2 * r, r + 1): plain[2 * r] / 2 for r in range(len(ROLES))}
        prior |= {("mark", s, 0): MARK_PRIOR for s in range(STATES)}
        prior |= {("gap", s, 2): plain[s] for s in range(STATES)}
        prior |= {("gap", s, 1 - s % 2): 1.0 for s in range(STATES)}
        counts = {k: counts.get(k, 0) + prior.get(k, 0) for k in counts.keys() | prior.keys()}
        start = table("start", 1, STATES)
        start[0, 1::2] = 1e-9  # a transcript begins with a first line
        step = table("step", STATES, STATES)
        for s in range(STATES):  # later lines follow lines of their own role
            step[s, 1::2] = np.where(np.arange(len(ROLES)) == s // 2, step[s, 1::2], 1e-9)
        self.start = np.log(start / start.sum())[0]
        self.step = np.log(step / step.sum(1, keepdims=True))
        self.shows = []
        for f, n in zip(FEATURES, SIZES):
            t = table(f, STATES, n)
            if f not in ("mark", "gap"):  # rare states show what all show
                t += POOLED * t.sum(0) / t.sum()
            self.shows.append(np.log(t / t.sum(1, keepdims=True)))

    def states(self, seen: list[tuple[int, ...]]) -> list[int]:
        """The likeliest states of lines with these features (ties: the
        smaller state)."""
        if not seen:
            return []
        obs = np.asarray(seen)
        shows = sum(t[:, obs[:, i]] for i, t in enumerate(self.shows)).T
        best = self.start + shows[0]
        back = np.zeros((len(seen), STATES), np.int8)
        for i in range(1, len(seen)):
            paths = best[:, None] + self.step
            back[i] = paths.argmax(0)
            best = paths.max(0) + shows[i]
        out = [int(best.argmax())]
        for i in range(len(seen) - 1, 0, -1):
            out.append(int(back[i, out[-1]]))
        return out[::-1]


def turns_of(text: str | None, hmm: Hmm) -> tuple[list[tuple[str, str]], list[int]]:
    """(role, text) of the turns that the model sees, and each line's state."""
    lines, gaps = split_lines(text)
    states = hmm.states([line_features(x, g) for x, g in zip(lines, gaps)])
    turns: list[tuple[str, list[str]]] = []
    for line, s in zip(lines, states):
        if s % 2 == 0:
            m = _MARK.match(line)
            body = line[m.end():] if m and MARKS[m[1].lower()] == ROLES[s // 2] else line
            turns.append((ROLES[s // 2], [body]))
        else:
            turns[-1][1].append(line)
    return [(r, "\n".join(x).strip()) for r, x in turns], states


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def transcripts(conversations: DataFrame) -> DataFrame:
    """One row per conversation (piece): conv_id, piece, its turns' texts with
    blank lines between them, and the table's role of every line."""
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    piece = F.coalesce(F.floor(F.col("turn") / PIECE_TURNS), F.lit(0)).cast("long")
    lone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text", F.monotonically_increasing_id()))
    rows = rows.withColumn("piece", piece).withColumn("_lone", lone)
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    one = rows.groupBy("conv_id", "_lone", "piece").agg(turns.alias("t"))
    lines = F.transform("t", lambda t: F.transform(
        F.filter(F.split(t["text"], r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: x.rlike(r"\S")), lambda _: F.coalesce(t["role"], F.lit(""))))
    return one.select("conv_id", "piece", F.array_join(F.transform("t", lambda t: t["text"]), "\n\n").alias("text"),
                      F.flatten(lines).alias("line_roles"),
                      F.flatten(F.transform(lines, lambda x: F.transform(x, lambda _, i: i == 0))).alias("line_first"))


def in_training(conv_id, folds: int = 5):
    return F.pmod(F.crc32(F.coalesce(conv_id.cast("string"), F.lit(""))), F.lit(folds)) != 0


def train(labelled: DataFrame) -> Hmm:
    """Count the model's weights on transcripts with line roles."""
    def count(batches):
        for b in batches:
            counts: dict[tuple[str, int, int], int] = {}
            for text, roles, firsts in zip(*(b[c].to_pylist() for c in ("text", "line_roles", "line_first"))):
                lines, gaps = split_lines(text)
                if len(lines) != len(roles) or any(r not in ROLES for r in roles):
                    continue
                states = [2 * ROLES.index(r) + (0 if f else 1) for r, f in zip(roles, firsts)]
                keys = [("start", 0, states[0])] if states else []
                keys += [("step", x, y) for x, y in zip(states, states[1:])]
                for s, line, gap in zip(states, lines, gaps):
                    keys += [(f, s, v) for f, v in zip(FEATURES, line_features(line, gap))]
                for k in keys:
                    counts[k] = counts.get(k, 0) + 1
            cols = list(zip(*[(*k, n) for k, n in counts.items()])) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string())] + [pa.array(c, pa.int64()) for c in cols[1:]],
                                             names=["kind", "state", "value", "n"])

    rows = labelled.select("text", "line_roles", "line_first").mapInArrow(count, "kind string, state long, value long, n long")
    total = rows.groupBy("kind", "state", "value").agg(F.sum("n").alias("n")).collect()  # bounded by the model's size
    return Hmm({(r["kind"], r["state"], r["value"]): r["n"] for r in total})


RESULT = ("conv_id long, piece long, n_lines long, n_turns long, roles string, rendered string, rendered_sha256 string, "
          "lines_agree double")


def format_chats(texts: DataFrame, hmm: Hmm) -> DataFrame:
    """Turns and canonical text of each transcript of ``texts`` (conv_id,
    piece, text, line_roles); ``lines_agree`` is the share of lines whose role
    is the table's (null without lines)."""
    def parse(batches):
        for b in batches:
            out = []
            for conv, piece, text, truth in zip(*(b[c].to_pylist() for c in ("conv_id", "piece", "text", "line_roles"))):
                turns, states = turns_of(text, hmm)
                full = render(turns)
                agree = sum(ROLES[s // 2] == r for s, r in zip(states, truth)) / len(states) if states else None
                out.append((conv, piece, len(states), len(turns), ",".join(r for r, _ in turns), full,
                            hashlib.sha256(full.encode()).hexdigest(), agree))
            cols = list(zip(*out)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=[x.split()[0] for x in RESULT.split(", ")])

    return texts.select("conv_id", "piece", "text", "line_roles").mapInArrow(parse, RESULT)
