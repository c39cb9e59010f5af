"""The model of a byte-level BPE tokenizer: vocabulary, merge rules, added tokens; reading and writing it as JSON."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..functions.bytemap import decode_text, encode_bytes

MOST_ID = (1 << 32) - 1


class ModelError(ValueError):
    """A model file that can't be taken."""


#: Bytes up to which a plain list is faster to merge than a linked one.
SHORT = 64


@dataclass(frozen=True)
class AddedToken:
    id: int
    content: bytes
    special: bool = True


@dataclass(frozen=True)
class BpeModel:
    """``vocab``: (bytes, id) in file order; ``merges``: (left, right) by rank, None for a rule that can't match."""

    vocab: tuple[tuple[bytes | None, int], ...]
    merges: tuple[tuple[bytes, bytes] | None, ...] = ()
    added: tuple[AddedToken, ...] = ()
    extra: dict = field(default_factory=dict, compare=False)

    @cached_property
    def ids(self) -> dict[bytes, int]:
        """Token to id; of a token that comes twice, the lowest."""
        out: dict[bytes, int] = {}
        for token, i in self.vocab:
            if token is not None:
                out[token] = min(i, out.get(token, i))
        return out

    @cached_property
    def tokens(self) -> dict[int, bytes]:
        return {i: t for t, i in sorted(((t, i) for t, i in self.vocab if t is not None), reverse=True)} | {a.id: a.content for a in self.added}

    @cached_property
    def ranks(self) -> dict[tuple[bytes, bytes], int]:
        """Split pair to rank; of a rule that comes twice, the lowest."""
        out: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(self.merges):
            if pair is not None:
                out.setdefault(pair, rank)
        return out

    @cached_property
    def specials(self) -> list[AddedToken]:
        """Those that match: special, not empty; the longest first, then in file order; one for each content."""
        seen: dict[bytes, AddedToken] = {}
        for a in self.added:
            if a.special and a.content:
                seen.setdefault(a.content, a)
        return sorted(seen.values(), key=lambda a: -len(a.content))

    @property
    def vocab_size(self) -> int:
        return len(self.vocab)

    @property
    def max_id(self) -> int:
        return max((i for _, i in self.vocab), default=-1)

    @cached_property
    def folds(self) -> bool:
        """Whether applying each rule once in the order of ranks gives the same as merging by rank.

        True if every rule's sides exist before it (bytes, or products of earlier rules), no product has two rules
        and no rule comes twice.
        """
        made: set[bytes] = set()
        for pair in self.merges:
            if pair is None:
                continue
            if any(len(side) > 1 and side not in made for side in pair) or pair[0] + pair[1] in made:
                return False
            made.add(pair[0] + pair[1])
        return True

    def merge(self, data: bytes) -> list[bytes]:
        """A pretoken's symbols: while a neighbouring pair has a rule, the pair of lowest rank is joined wherever it stands."""
        return self._merge_long(data) if len(data) > SHORT else self._merge_short(data)

    def _merge_short(self, data: bytes) -> list[bytes]:
        parts, rank_of = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        none = len(self.merges)
        ranks = [rank_of(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (rank := min(ranks)) < none:
            i = 0
            while rank in ranks[i:]:
                i = ranks.index(rank, i)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = rank_of((parts[i], parts[i + 1]), none)
                if i:
                    ranks[i - 1] = rank_of((parts[i - 1], parts[i]), none)
        return parts

    def _merge_long(self, data: bytes) -> list[bytes]:
        """In time that grows with the bytes, about.

        Symbols are a linked list by their first byte's place. Places wait under the rank of the pair that begins
        there; all of the lowest rank are taken at once, from the left, and checked, as a neighbour may have changed.
        """
        ranks, n = self.ranks, len(data)
        parts: list[bytes] = [data[i : i + 1] for i in range(n)]
        behind, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: dict[int, list[int]] = {}
        heap: list[int] = []

        def wait(i: int) -> None:
            rank = ranks.get((parts[i], parts[behind[i]]))
            if rank is not None:
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(heap, rank)
                waiting[rank].append(i)

        for i in range(n - 1):
            wait(i)
        while heap:
            rank = heapq.heappop(heap)
            pair, fresh = self.merges[rank], []
            for i in sorted(set(waiting.pop(rank))):
                j = behind[i]
                if j >= n or (parts[i], parts[j]) != pair or not parts[i]:
                    continue
                parts[i], parts[j] = parts[i] + parts[j], b""
                behind[i] = behind[j]
                if behind[i] < n:
                    before[behind[i]] = i
                fresh.append(i)
            for i in fresh:
                if before[i] >= 0:
                    wait(before[i])
                if behind[i] < n:
                    wait(i)
        return [p for p in parts if p]

    # Tables

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        """``token`` (hex), ``id``: one row for each token."""
        return spark.createDataFrame([(t.hex().upper(), i) for t, i in self.ids.items()], "token string, id long")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        """``rank``, ``left``, ``right``, ``merged`` (hex): one row for each rule."""
        rows = [(r, a.hex().upper(), b.hex().upper(), (a + b).hex().upper()) for (a, b), r in self.ranks.items()]
        return spark.createDataFrame(rows, "rank int, left string, right string, merged string")

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: pretokenizer, vocabulary size, largest id, merge rules, added tokens."""
        row = ("ByteLevel", self.vocab_size, self.max_id, len(self.merges), len(self.added))
        return spark.createDataFrame([row], "pretokenizer string, vocab_size long, max_id long, merge_rules long, added_tokens long")


def _unique(pairs: list[tuple[str, object]]) -> dict:
    return {"\0pairs": pairs, **dict(pairs)}


def _id(value: object) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not 0 <= value <= MOST_ID:
        raise ModelError(f"an id that isn't a number from 0 to {MOST_ID}: {value!r}")
    return value


def _rule(item: object, as_pairs: bool) -> tuple[bytes, bytes] | None:
    if as_pairs:
        if not isinstance(item, list) or len(item) != 2 or not all(isinstance(x, str) for x in item):
            raise ModelError(f"a merge rule that isn't a pair: {item!r}")
        left, right = item
    else:
        if not isinstance(item, str) or " " not in item:
            raise ModelError(f"a merge rule without two sides: {item!r}")
        left, right = item.split(" ", 1)
    if not left or not right:
        raise ModelError(f"a merge rule with an empty side: {item!r}")
    if any(ord(c) > 0x143 for c in left + right):
        raise ModelError(f"a merge rule with a character outside the alphabet: {item!r}")
    a, b = decode_text(left), decode_text(right)
    return None if a is None or b is None else (a, b)


def parse_model(text: str) -> BpeModel:
    """A model from the JSON of a tokenizer file; more is refused than what can't be read: other model types and normalizers."""
    try:
        top = json.loads(text, object_pairs_hook=_unique)
    except ValueError as e:
        raise ModelError(f"not JSON: {e}") from e
    if not isinstance(top, dict) or not isinstance(top.get("model"), dict):
        raise ModelError("no model")
    if not isinstance(top.get("pre_tokenizer"), dict) or top["pre_tokenizer"].get("type") != "ByteLevel":
        raise ModelError("the pretokenizer must be ByteLevel")
    if top.get("normalizer") is not None:
        raise ModelError("a normalizer isn't supported")
    model = top["model"]
    if model.get("type", "BPE") != "BPE":
        raise ModelError("the model must be BPE")
    vocab = model.get("vocab")
    if not isinstance(vocab, dict) or not vocab["\0pairs"]:
        raise ModelError("no vocabulary")
    merges = model.get("merges", [])
    as_pairs = bool(merges) and isinstance(merges[0], list)
    added = []
    for a in top.get("added_tokens") or []:
        added.append(AddedToken(_id(a.get("id")), str(a.get("content", "")).encode("utf-8"), bool(a.get("special", False))))
    return BpeModel(tuple((decode_text(k), _id(v)) for k, v in vocab["\0pairs"]), tuple(_rule(m, as_pairs) for m in merges), tuple(added))


def load_model(spark: SparkSession, path: str) -> BpeModel:
    """Read a tokenizer file through Spark's readers, so from any store."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise ModelError(f"no file at {path}")
    try:
        return parse_model(bytes(row["content"]).decode("utf-8"))
    except UnicodeDecodeError as e:
        raise ModelError("not UTF-8") from e


def dump_model(model: BpeModel) -> str:
    """The JSON of a tokenizer file: vocabulary by id, merges as two sides with a space, as the reader takes them."""
    keys: dict[str, int] = {}
    for token, i in sorted(model.vocab, key=lambda x: x[1]):
        if token is not None:
            keys.setdefault(encode_bytes(token), i)
    return json.dumps(
        {
            "version": "1.0", "truncation": None, "padding": None,
            "added_tokens": [{"id": a.id, "content": a.content.decode("utf-8", "replace"), "special": a.special} for a in model.added],
            "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "post_processor": None, "decoder": {"type": "ByteLevel"},
            "model": {"type": "BPE", "vocab": keys, "merges": [f"{encode_bytes(p[0])} {encode_bytes(p[1])}" for p in model.merges if p is not None]},
        },
        ensure_ascii=False,
    )


def save_model(spark: SparkSession, model: BpeModel, path: str) -> None:
    """Write the file (one part in the folder ``path``) through Spark's writers."""
    spark.createDataFrame([(dump_model(model),)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\n")
