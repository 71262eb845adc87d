"""Token counts by prefix dynamic programming, exact for the SentencePiece BPE model.

The encoding of a prefix that ends with token t is the encoding of the prefix
before t, followed by t, where t is the one token that may follow: no merge would
cross the border between the two. So one pass over a text gives the exact token
count at every prefix, and truncation or budget questions need no encoding.

No piece of such a model holds a space mark after another character, nor letters
beside other characters, so merges never leave a segment (space marks, then
letters or else other characters). Segments are counted once and remembered (a bounded number of them), and a text's
counts are sums over its segments.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
#: Space marks, then letters or else other characters: where the model has no piece across such a border, no merge crosses it.
FINE = re.compile(rf"{MARK}*(?:[^\W\d_²]+|(?:(?!{MARK})[\W\d_²])+)|{MARK}+")
COARSE = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Segments and token pairs that are remembered in a worker; longer segments are counted anew each time.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64


class _Words(dict):
    """Token counts of words with a space mark before them, filled as they are asked for."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        n = self.count(MARK + word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


class PrefixCounter:
    """The token count at every prefix of a text."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
        proto.normalizer_spec.add_dummy_prefix = False
        #: The same merges without a space mark put in front: it says how two tokens are encoded together.
        self.bare = SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.score: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.score) or model.encode("  ﬁ", out_type=str)[1:2] != [" "]:
            raise ValueError("only models without normalisation whose pieces hold space marks at their start alone")
        self.longest = max(map(len, self.score))
        self.cut = FINE if all(FINE.fullmatch(p) for p in self.score) else COARSE
        #: All beginnings of pieces, and whether they are pieces themselves.
        self.begun = dict.fromkeys((p[:i] for p in self.score for i in range(1, len(p))), False) | dict.fromkeys(self.score, True)
        self.follows: dict[str, dict[str, bool]] = {}
        self.n_follows = 0
        self.counts: dict[str, int] = {}
        self.words = _Words(self._count)

    def _may_follow(self, before: str, token: str) -> bool:
        """Whether ``before`` and then ``token`` is how the two are encoded together; before is empty at borders that nothing crosses."""
        if self.n_follows >= REMEMBERED:
            self.follows.clear()
            self.n_follows = 0
        self.n_follows += 1
        known = self.bare.encode(before + token, out_type=str) == ([before, token] if before else [token])
        self.follows.setdefault(before, {})[token] = known
        return known

    def segment(self, segment: str) -> list[int]:
        """Counts after each character of a segment."""
        n, begun = len(segment), self.begun
        counts: list = [0] + [None] * n
        last = [""] * (n + 1)
        for start in range(n):
            if counts[start + 1] is None and segment[start] not in self.score:
                # No piece has this character: a token for each of its bytes, which merge with nothing.
                counts[start + 1] = counts[start] + len(segment[start].encode("utf-8", "surrogatepass"))
                continue
            before = last[start]
            follows = self.follows.get(before, {})
            for end in range(start + 1, n + 1):
                token = segment[start:end]
                whole = begun.get(token)
                if whole is None:
                    break
                if whole and counts[end] is None:
                    known = follows.get(token)
                    if known or known is None and self._may_follow(before, token):
                        counts[end], last[end] = counts[start] + 1, token
        return counts[1:]

    def count(self, text: str) -> int:
        """Tokens of the whole text. Where single spaces alone part words, nothing crosses them, so a word's count is known from the last time."""
        if not text:
            return 0
        if text[0] == " " or MARK in text or "  " in text:
            return self._count(MARK + text.replace(" ", MARK))
        return sum(map(self.words.__getitem__, text.split(" ")))

    def _count(self, marked: str) -> int:
        n, known = 0, self.counts
        for s in self.cut.findall(marked):
            c = known.get(s)
            if c is None:
                c = self.segment(s)[-1]
                if len(s) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[s] = c
            n += c
        return n

    def prefixes(self, text: str) -> list[int]:
        """Entry i is the token count of the text's first i characters; entry 0 is 0."""
        out, n = [], 0
        for s in self.cut.findall(MARK + text.replace(" ", MARK)) if text else ():
            counts = self.segment(s)
            out += [n + c for c in counts]
            n += counts[-1]
        return [0, *out[1:]]

    def truncated(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        n, at, best = 0, 0, 0
        for s in self.cut.findall(MARK + text.replace(" ", MARK)) if text else ():
            counts = self.segment(s)
            best = max([best, *(at + i + 1 for i, c in enumerate(counts) if n + c <= budget)])
            n, at = n + counts[-1], at + len(s)
            if n > budget + self.longest:
                break
        return text[: max(0, best - 1)]


@lru_cache(maxsize=2)
def counter(model: str) -> PrefixCounter:
    import public_tokenizers

    return PrefixCounter(public_tokenizers.path(model) if "/" not in model else model)


def count_tokens(docs: DataFrame, text: str = "text", model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit; columns of these names are replaced.

    A null or empty text has 0 bytes and 0 tokens. Special strings inside texts are
    ordinary text. Each text is counted whole, by itself, whatever its length: no
    shuffle. Repeated rows count alike; an empty table gives an empty result. Other
    columns pass through.
    """

    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([counter(model).count(t.as_py() or "") for t in texts], pa.int64())

    return docs.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
            "n_tokens": F.arrow_udf(counted, "long")(F.col(text)),
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def truncate_tokens(docs: DataFrame, budget: int, text: str = "text", model: str = MODEL) -> DataFrame:
    """docs with each text cut to its longest prefix of at most ``budget`` tokens.

    Null stays null and an empty text empty; an empty table gives an empty result.
    Other columns pass through, whatever their names.
    """

    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([None if (t := x.as_py()) is None else counter(model).truncated(t, budget) for x in texts], pa.string())

    return docs.withColumn(text, F.arrow_udf(cut, "string")(F.col(text)))
