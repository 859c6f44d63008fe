"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

A declarative template gives each role its marks, whether its text is learnt, and the roles
that may follow. Formatting emits three segments a turn: the opening mark, the text and the
closing mark, each with a loss flag. A turn that the machine does not allow is still written
out, so nothing is lost; its conversation is flagged as not valid.

Control strings, that is all marks without outer blanks, cannot come from a text: each one in
a text or a role becomes ESCAPE index ESCAPE, and ESCAPE itself ESCAPE _ ESCAPE. No control
string holds ESCAPE, so no escaped text holds a control string, and what is between two
ESCAPEs tells what was there. Templates in which the end of one control string could begin
another are refused, so none can arise where a text meets a mark either.

Scale: turns are shuffled by conversation, sorted, and streamed; state is one turn and one
running hash, so a conversation of any length needs the memory of its longest turn. A digest
over a whole conversation is one sequential hash, so its turns must pass one task in order.

Edge cases: a null text or role is empty, a role without marks gets the template's open ones,
null conv_ids are one conversation, turns come by turn (nulls first), then role, then text,
so ties and repeated rows have a fixed order. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwell.llm.common import read

ESCAPE = "␛"


@dataclass(frozen=True)
class Role:
    opens: str
    closes: str
    loss: bool
    follows: tuple[str, ...]  # roles after which this one may come; "" is the start
    may_end: bool = False


@dataclass(frozen=True)
class Template:
    roles: tuple[tuple[str, Role], ...]
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")  # for roles without marks: around the role's name, and after the text

    def control(self) -> list[str]:
        marks = [m.strip() for _, r in self.roles for m in (r.opens, r.closes)] + list(self.other)
        return sorted({m for m in marks if m}, key=lambda m: (-len(m), m))

    def check(self) -> None:
        """Refuse templates whose marks a text could imitate together with a mark beside it."""
        control = self.control()
        for _, r in self.roles:
            if not r.opens.strip() or not r.closes.strip():
                raise ValueError("every mark needs more than blanks")
        for a in control:
            if ESCAPE in a:
                raise ValueError("a mark holds the escape sign")
            for b in control:
                if any(b.startswith(a[i:]) or a[i:].startswith(b) for i in range(1, len(a))):
                    raise ValueError(f"the end of {a!r} can begin {b!r}")


INSTRUCT = Template(
    roles=(
        ("system", Role("[SYS] ", " [/SYS]\n", False, ("",))),
        ("user", Role("[INST] ", " [/INST]\n", False, ("", "system", "assistant"), may_end=True)),
        ("assistant", Role("<s> ", " </s>\n", True, ("user",), may_end=True)),
    )
)
SEGMENT = "conv_id long, turn int, valid boolean, opens string, text string, closes string, loss boolean"


class Codec:
    """Escapes and unescapes texts, and reads turns back."""

    def __init__(self, template: Template) -> None:
        template.check()
        control = template.control()
        self.index = {c: i for i, c in enumerate(control)} | {ESCAPE: "_"}
        self.back = {str(i): c for c, i in self.index.items()}
        self.roles = dict(template.roles)
        self.other = template.other
        self.held = re.compile("|".join(map(re.escape, [ESCAPE, *control])))
        self.token = re.compile(f"{ESCAPE}(\\d+|_){ESCAPE}")
        first, between, last = map(re.escape, template.other)
        self.turns = [(name, re.compile(f"{re.escape(r.opens)}(.*){re.escape(r.closes)}", re.S)) for name, r in self.roles.items()]
        self.plain = re.compile(f"{first}(.*?){between}(.*){last}", re.S)

    def escape(self, text: str) -> str:
        return self.held.sub(lambda m: f"{ESCAPE}{self.index[m[0]]}{ESCAPE}", text)

    def unescape(self, text: str) -> str:
        return self.token.sub(lambda m: self.back[m[1]], text)

    def write(self, role: str, text: str) -> tuple[str, str, str, bool]:
        if r := self.roles.get(role):
            return r.opens, self.escape(text), r.closes, r.loss
        return f"{self.other[0]}{self.escape(role)}{self.other[1]}", self.escape(text), self.other[2], False

    def read(self, written: str) -> tuple[str, str]:
        """(role, text) of one written turn."""
        for name, form in self.turns:
            if m := form.fullmatch(written):
                return name, self.unescape(m[1])
        m = self.plain.fullmatch(written)
        return self.unescape(m[1]), self.unescape(m[2])


def _ordered(turns: DataFrame) -> DataFrame:
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    return turns.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chat(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row a turn: its three segments, the loss flag of the text (marks have none), and whether the machine allowed it. Rows of a conversation stay together and in order."""
    template.check()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, conv, state, n = Codec(template), object(), "", 0
        for b in batches:
            rows = []
            for c, role, text in zip(b.conv_id, b.role, b.text, strict=True):
                c = None if pd.isna(c) else int(c)
                if c != conv:
                    conv, state, n = c, "", 0
                r = codec.roles.get(role)
                valid = r is not None and state in r.follows
                rows.append((c, n, valid, *codec.write(role, text)))
                state, n = role, n + 1
            out = pd.DataFrame(rows, columns=["conv_id", "turn", "valid", "opens", "text", "closes", "loss"])
            yield out.astype({"conv_id": "Int64"})

    return _ordered(turns).mapInPandas(run, SEGMENT)


def segments(formatted: DataFrame) -> DataFrame:
    """The same as one row a segment: conv_id, turn, segment, text, loss."""
    no = F.lit(False)
    parts = F.array(*(F.struct(F.lit(i).alias("segment"), F.col(c).alias("text"), (F.col("loss") if c == "text" else no).alias("loss")) for i, c in enumerate(("opens", "text", "closes"))))
    return formatted.select("conv_id", "turn", F.explode(parts).alias("s")).select("conv_id", "turn", "s.*")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row a conversation, from the output of format_chat alone: what its written turns say."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(template)
        conv, open_ = object(), None
        ends = {name for name, r in codec.roles.items() if r.may_end}

        def close() -> tuple:
            n, turns, chars, loss, size, valid, role = open_
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, valid and role in ends

        for b in batches:
            done = []
            for c, valid, opens, text, closes, loss in zip(b.conv_id, b.valid, b.opens, b.text, b.closes, b.loss, strict=True):
                c = None if pd.isna(c) else int(c)
                if open_ is None or c != conv:
                    if open_ is not None:
                        done.append(close())
                    conv, open_ = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, ""]
                role, said = codec.read(opens + text + closes)
                open_[0] += 1
                open_[1].update(f"{role}\n{said}\n".encode())
                if loss:
                    learnt = codec.unescape(text)
                    open_[2] += len(learnt)
                    open_[3].update(learnt.encode())
                open_[4] += len(opens) + len(text) + len(closes)
                open_[5], open_[6] = open_[5] and bool(valid), role
            yield frame(done)
        if open_ is not None:
            yield frame([close()])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]).astype({"conv_id": "Int64"})

    return formatted.mapInPandas(run, DIGEST)


CONTROL_CASE = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts are control strings."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    case = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_CASE).alias("text"))
    return read_back(format_chat(turns.unionByName(case)))


OP4_SQL = f"""
WITH turns AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_CASE}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_CASE}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM turns),
e AS (SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prev, length(text) - length(replace(text, chr(9243), '')) AS escapes,
  (SELECT coalesce(sum(CAST((length(text) - length(replace(text, m, ''))) / length(m) AS BIGINT) * (3 - length(m))), 0)
   FROM (VALUES ('[/INST]'), ('[INST]'), ('[/SYS]'), ('[SYS]'), ('</s>'), ('<s>')) v(m)) AS grown FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + 2 * escapes + grown + CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 END) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN prev = '' WHEN 'user' THEN prev IN ('', 'system', 'assistant') WHEN 'assistant' THEN prev = 'user' ELSE false END)
    AND arg_max(role, pos) IN ('user', 'assistant') AS valid
FROM e GROUP BY conv_id
"""
