"""Texts to token ids with the tokenizers library, word by word.

The tokenizer file's normaliser and splitter never look across ASCII white space (it is
dropped, and neither composition nor lower-casing joins characters over it), so the ids of a text are
those of its words in order. Each batch therefore encodes every distinct word once.
Words of plain letters and punctuation are cut into the splitter's pieces here and go to a
bare copy of the same model; any other word goes through the tokenizer as it is.
"""

from __future__ import annotations

import os

import numpy as np

from .common import trim

DEFAULT = "word_bpe_49k.json"
#: Letters whose lower case is one character and that composition leaves alone; punctuation without the apostrophe.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGNS = "!-&(-/:-@\\[-`{-~"
_PLAIN = f"^(?P<a>[{_SIGNS}]*)(?P<b>[{_LETTERS}]*)(?P<c>[{_SIGNS}]*)$"


def vocabulary(path: str | None = None) -> str:
    """The tokenizer file: a path, or a public file's name."""
    if path and os.path.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path or DEFAULT)


class Known:
    """Strings met before and their ids, in Arrow and numpy; full at `most` strings, it only answers."""

    def __init__(self, most: int):
        import pyarrow as pa

        self.most, self.words = most, pa.array([], pa.large_string())
        self.ids, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def look(self, distinct, find) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all strings in `distinct`, their number per string); find() gives both for those not known."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(distinct, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = at < 0
        fresh = distinct.filter(pa.array(new))
        ids, n = find(fresh)
        at[new] = len(self.n) + np.arange(len(fresh))
        flat, sizes = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])
        if len(sizes) <= self.most:
            self.words, self.ids, self.n = pa.concat_arrays([self.words, fresh]), flat, sizes
        return _pick(flat, sizes, at), sizes[at]


class Encoder:
    """Encodes columns of texts; one for each file and process. It keeps up to `keep` words and pieces (about 100 bytes each) until its task ends."""

    _made: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str | None = None) -> "Encoder":
        name = path or DEFAULT
        if name not in cls._made:
            cls._made[name] = cls(name)
        return cls._made[name]

    def __init__(self, name: str, keep: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(vocabulary(name))
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for word, i in self.whole.get_vocab(False).items() if word.endswith("</w>")]] = True
        self.keep = keep
        self.forget()

    def forget(self) -> None:
        """Drops the words that it knows, so that a worker between tasks holds none of them."""
        self.words, self.parts = Known(self.keep), Known(self.keep)
        trim()

    def _new_words(self, distinct):
        """(ids of the distinct words, one word's after another; their number per word)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        parts = pc.extract_regex(distinct, _PLAIN)
        plain = pc.and_(parts.is_valid(), pc.invert(pc.match_substring(distinct, "<|"))).to_numpy(zero_copy_only=False)
        lists, counts = [], np.zeros(len(distinct), np.int64)
        easy = parts.filter(pa.array(plain))
        if len(easy):
            one = [pc.struct_field(easy, i).dictionary_encode() for i in range(3)]
            every = pa.concat_arrays([pc.utf8_lower(x.dictionary) for x in one]).dictionary_encode()
            base, code = 0, np.zeros((len(easy), 3), np.int64)
            place = every.indices.to_numpy()
            for i, x in enumerate(one):
                code[:, i] = place[base : base + len(x.dictionary)][x.indices.to_numpy()]
                base += len(x.dictionary)
            ids, n = self.parts.look(every.dictionary, self._new_parts)
            lists.append(_pick(ids, n, code.ravel()))
            counts[plain] = n[code].sum(1)
        hard = np.flatnonzero(~plain)
        if len(hard):
            found = [e.ids for e in self.whole.encode_batch_fast(distinct.take(pa.array(hard)).to_pylist(), add_special_tokens=False)]
            counts[hard] = [len(x) for x in found]
            lists.append(np.array([y for x in found for y in x], np.int32))
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        order = np.concatenate([np.flatnonzero(plain), hard])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return _pick(flat, counts[order], back), counts

    def _new_parts(self, distinct):
        """The same of lower-case pieces without white space, through one long text; a piece's last token carries the end-of-word mark."""
        import pyarrow as pa
        import pyarrow.compute as pc

        n = np.zeros(len(distinct), np.int64)
        full = pc.greater(pc.binary_length(distinct), 0)
        ids = np.zeros(0, np.int32)
        if some := distinct.filter(full).to_pylist():
            few = [" ".join(some[i : i + 20_000]) for i in range(0, len(some), 20_000)]  # an encoding takes far more memory than its ids
            ids = np.concatenate([np.array(self.bare.encode_batch_fast([x], add_special_tokens=False)[0].ids, np.int32) for x in few])
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(some):
                raise ValueError("the model has no end-of-word tokens for every byte")
            n[full.to_numpy(zero_copy_only=False)] = np.diff(last, prepend=-1)
        return ids, n

    def encode(self, column, end: int | None = 1) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another, each followed by `end` unless that is None; their number per text). Null is the empty text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        split = pc.ascii_split_whitespace(column.fill_null("").cast(pa.large_string()))
        per = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        del split
        code, distinct = coded.indices.to_numpy(), coded.dictionary
        ids, n = self.words.look(distinct, self._new_words)
        if end is not None:  # a last word of its own for each text
            code = np.insert(code, np.cumsum(per), len(n))
            ids, n, per = np.append(ids, np.int32(end)), np.append(n, 1), per + 1
        size = n[code]
        upto = np.zeros(len(code) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        return _pick(ids, n, code), np.diff(upto[np.cumsum(per)], prepend=0)


def _pick(flat: np.ndarray, n: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of `flat` (run i has n[i] values) that `which` names, in that order."""
    size = n[which]
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    at = np.repeat(((np.cumsum(n) - n)[which] - stop + size).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return flat[at]


def batches(column, most: int = 8_000_000):
    """(first row, slice) of about `most` bytes of text each."""
    from .shingles import text_bytes

    _, ends = text_bytes(column)
    i = 0
    while i < len(ends):
        at = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, at + most, "right")))
        yield i, column.slice(i, j - i)
        i = j
        trim()


def merged(rows, most: int = 8_000_000):
    """Record batches put together to about `most` bytes, so that a word is looked up once for many texts."""
    import pyarrow as pa

    held, size = [], 0
    for batch in rows:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
