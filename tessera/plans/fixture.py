"""A small model with pinned rules, for queries whose SQL must know them."""

from __future__ import annotations

from .model import AddedToken, BpeModel

#: The first 64 canonical merges of a small corpus, as hex bytes, by rank.
MERGES = (
    ("74", "68"),
    ("20", "7468"),
    ("20", "65"),
    ("6f", "6e"),
    ("69", "6e"),
    ("72", "65"),
    ("20", "61"),
    ("74", "69"),
    ("68", "65"),
    ("6e", "64"),
    ("65", "72"),
    ("6c", "65"),
    ("20", "6f"),
    ("207468", "65"),
    ("6e", "74"),
    ("68", "61"),
    ("73", "74"),
    ("20", "c3"),
    ("2065", "72"),
    ("63", "68"),
    ("61", "6e"),
    ("7469", "6f6e"),
    ("20", "6f6e"),
    ("6c", "79"),
    ("62", "6c65"),
    ("20", "64"),
    ("696e", "67"),
    ("6f", "75"),
    ("6f", "72"),
    ("2065", "6e"),
    ("61", "74"),
    ("65", "6e"),
    ("77", "68"),
    ("65", "61"),
    ("65", "73"),
    ("73", "68"),
    ("2061", "6e"),
    ("206f", "66"),
    ("20", "696e"),
    ("20", "7265"),
    ("63", "69"),
    ("c3", "b3"),
    ("65", "64"),
    ("69", "74"),
    ("20", "6865"),
    ("20", "74"),
    ("75", "65"),
    ("69", "65"),
    ("6369", "c3b3"),
    ("2061", "6e64"),
    ("6369c3b3", "6e"),
    ("21", "21"),
    ("20", "54"),
    ("20c3", "a9"),
    ("20", "6e64"),
    ("71", "7565"),
    ("2074", "6f"),
    ("2064", "65"),
    ("2065", "64"),
    ("61", "73"),
    ("69", "73"),
    ("20", "6c"),
    ("20", "45"),
    ("65", "6e74"),
)
SPECIALS = ("<|endoftext|>", "the", "the and")


def fixture_model(specials: bool = False, vocab_size: int | None = None) -> BpeModel:
    """Bytes are the ids 0 to 255, rule k makes 256 + k; ``specials`` follow as added tokens; ``vocab_size`` keeps the first ids only."""
    rules = tuple((bytes.fromhex(a), bytes.fromhex(b)) for a, b in MERGES)
    tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in rules]
    vocab = tuple((t, i) for i, t in enumerate(tokens))[:vocab_size]
    added = tuple(AddedToken(len(tokens) + k, s.encode(), True) for k, s in enumerate(SPECIALS)) if specials else ()
    return BpeModel(vocab, rules, added)
