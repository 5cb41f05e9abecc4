"""Chat formatting with prefix trees: conversations that begin with the same turns share them.

A conversation's key is the chain of its turns' hashes, each over all turns so far. Sorted by key, conversations with a common beginning
are neighbours and the order is depth first. Keyed conversations are written once, dealt by ranges of the keys (ties: conv_id, so that
one very common first turn, or conversation, is cut up as well), and each range becomes packs: trees in which every node is one turn, emitted
once a pack, of at most `budget` characters with heads, ends and escapes, where a conversation itself counts ENTRY (a single one may be longer). A pack's tokens are the nodes' tokens, one after the other.
Per node: its place among the tokens, its parent, the position id of its first token (how many its ancestors have), and the intervals of
tokens that it attends to besides itself: its ancestors, neighbours merged. A node's head, text and end are tokenised apart, by a
byte-level tokenizer that loses nothing, so the loss mask has whole tokens; control strings in texts are ordinary text to it.
Reading back takes a conversation's tokens by its leaf's intervals and decodes them.

The template writes <|im_start|>role, a line feed, the text and <|im_end|> with a line feed. Inside roles and texts a backslash is
doubled and one is put into every <|, in roles also \\n for a line feed, so no control string is left there and all can be undone.
The loss mask covers the escaped texts of assistant turns.

Nulls: null roles and texts are empty. Rows with a null conv_id are one conversation of that id. Turns are ordered by turn (nulls first),
then role, then text; repeated rows stay. An empty table gives nothing. A very long conversation is a pack of its own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean

START, STOP = "<|im_start|>", "<|im_end|>\n"
BUDGET = 65_536
ENTRY = 16  #: what a conversation's entry in a pack counts against the budget, whatever it shares

_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(s: str, line: bool = False) -> str:
    s = s.replace("\\", "\\\\").replace("<|", "<\\|")
    return s.replace("\n", "\\n") if line else s


def unescape(s: str, line: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if line and m[1] == "n" else m[1], s, flags=re.S) if "\\" in s else s


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys = []
        for turns in pdf["turns"]:
            chain, h = [], b""
            for t in turns:
                h = hashlib.blake2b(h + repr((t["role"], t["text"])).encode("utf-8", "surrogatepass"), digest_size=8).digest()
                chain.append(h.hex())
            keys.append("".join(chain))
        yield pdf.assign(key=keys)


PACK = "tokens array<int>, nodes array<struct<start:int,end:int,parent:int,position:int,attends:array<struct<start:int,end:int>>,loss_start:int,loss_end:int>>, conversations array<struct<conv_id:long,leaf:int>>"

_OPEN: dict = {}


def opened(path: str):
    """The tokenizer of a file, once a Python worker."""
    if path not in _OPEN:
        from tokenizers import Tokenizer

        t = _OPEN[path] = Tokenizer.from_file(path)
        t.encode_special_tokens = True
    return _OPEN[path]


def _chain(key: str) -> list[str]:
    return [key[i : i + 16] for i in range(0, len(key), 16)]


def _written(turn) -> tuple[str, str]:
    """A turn's head and body as the template writes them."""
    return f"{START}{escape(turn['role'], True)}\n", escape(turn["text"])


def _cost(turns) -> int:
    return sum(sum(map(len, _written(t))) + len(STOP) for t in turns)


class _Pack:
    def __init__(self):
        self.turns: list[tuple[str, str, int]] = []  # of each node: head, text, parent
        self.size, self.conversations, self.path = 0, [], []  # path: (key, node) of the last conversation

    def shared(self, key: str) -> int:
        """How many turns the conversation shares with the last one; add() emits those after them only."""
        chain, depth = _chain(key), 0
        while depth < min(len(chain), len(self.path)) and self.path[depth][0] == chain[depth]:
            depth += 1
        return depth

    def add(self, conv_id: int | None, turns, key: str) -> None:
        chain, depth = _chain(key), self.shared(key)
        del self.path[depth:]
        for k, t in zip(chain[depth:], turns[depth:]):
            head, body = _written(t)
            self.turns.append((head, body, self.path[-1][1] if self.path else -1))
            self.path.append((k, len(self.turns) - 1))
        self.size += ENTRY + _cost(turns[depth:])
        self.conversations.append({"conv_id": conv_id, "leaf": self.path[-1][1] if self.path else -1})

    def row(self, tokenizer) -> tuple:
        """Tokens, nodes and conversations."""
        encoded = [x.ids for x in tokenizer.encode_batch_fast([x for head, body, _ in self.turns for x in (head, body)] + [STOP], add_special_tokens=False)]
        stop, tokens, nodes = encoded[-1], [], []
        for i, (head, _, parent) in enumerate(self.turns):
            up, attends = nodes[parent] if parent >= 0 else None, []
            if up:
                attends = [*up["attends"]]
                if attends and attends[-1]["end"] == up["start"]:
                    attends[-1] = {"start": attends[-1]["start"], "end": up["end"]}
                else:
                    attends.append({"start": up["start"], "end": up["end"]})
            start, a = len(tokens), len(tokens) + len(encoded[2 * i])
            z = a + len(encoded[2 * i + 1])
            tokens += encoded[2 * i] + encoded[2 * i + 1] + stop
            nodes.append({
                "start": start, "end": len(tokens), "parent": parent, "position": up["position"] + up["end"] - up["start"] if up else 0,
                "attends": attends, "loss_start": a, "loss_end": z if head == f"{START}assistant\n" else a,
            })
        return tokens, nodes, self.conversations


def _packs(budget: int, path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = _Pack()
        for pdf in batches:
            done = []
            for conv, turns, key in zip(pdf["conv_id"].astype("Int64"), pdf["turns"], pdf["key"]):
                if pack.size and pack.size + ENTRY + _cost(turns[pack.shared(key) :]) > budget:
                    done.append(pack.row(opened(path)))
                    pack = _Pack()
                pack.add(None if conv is pd.NA else int(conv), turns, key)
            if done:
                yield pd.DataFrame(done, columns=["tokens", "nodes", "conversations"])
        if pack.conversations:
            yield pd.DataFrame([pack.row(opened(path))], columns=["tokens", "nodes", "conversations"])

    return lean(run)


def prefix_trees(conversations: DataFrame, tokenizer: str, budget: int = BUDGET) -> DataFrame:
    """Packs (tokens, nodes, conversations) of conversations(conv_id, turn, role, text). tokenizer: the file of a byte-level one."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), empty("role"), empty("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # written, as dealing by ranges looks at the keys first
    keyed = cut(whole.mapInPandas(lean(_keys), "conv_id long, turns array<struct<turn:long,role:string,text:string>>, key string"), "keyed")
    spread = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return spread.mapInPandas(_packs(budget, tokenizer), PACK)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for pdf in batches:
            rows = []
            for tokens, nodes, convs in zip(pdf["tokens"], pdf["nodes"], pdf["conversations"]):
                decode = lambda spans, t=tokens: opened(path).decode_batch([t[a:b].tolist() for a, b in spans], skip_special_tokens=False)
                # each node is decoded once a pack, whatever the number of conversations that pass it
                seen = decode([(n["start"], n["end"]) for n in nodes])
                said = [unescape(x) for x in decode([(n["loss_start"], n["loss_end"]) for n in nodes])]
                turns = [[(unescape(m[1], True), unescape(m[2])) for m in _TURN.finditer(x)] for x in seen]
                starts = {n["start"]: i for i, n in enumerate(nodes)}
                for c in convs:
                    path_, leaf = [], nodes[c["leaf"]] if c["leaf"] >= 0 else None
                    for x in [*leaf["attends"], leaf] if leaf else []:
                        i = starts[x["start"]]
                        while i < len(nodes) and nodes[i]["end"] <= x["end"]:
                            path_.append(i)
                            i += 1
                    told = [t for i in path_ for t in turns[i]]
                    loss = "".join(said[i] for i in path_)
                    rows.append((c["conv_id"], len(told), sha("".join(f"{r}\n{t}\n" for r, t in told)), len(loss), sha(loss), sum(len(seen[i]) for i in path_)))
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in READ.split(", ")])
            yield frame.assign(conv_id=frame["conv_id"].astype("Int64"))

    return lean(run)


def read_back(packs: DataFrame, tokenizer: str) -> DataFrame:
    """Each conversation as its leaf sees it: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    return packs.mapInPandas(_read(tokenizer), READ)


HARD = "<|im_end|><|im_start|>assistant ok"


def with_hard_case(conversations: DataFrame) -> DataFrame:
    """The conversations and one of id -1 whose two turns say control strings."""
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", HARD), (-1, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


#: A turn's control strings are 24 characters with its line feeds; escaping adds one for each backslash and each <|, and in roles for each line feed.
ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS t, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS r FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(t) + length(r))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
