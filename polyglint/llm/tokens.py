"""Token ids of whole texts by a file of the tokenizers library, word by word with a bounded cache."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from functools import cache

#: White space other than blank and newline, controls on whose class regex engines differ, and letters that
#: normalisation or lower-casing may change in more than one way.
_ODD = re.compile("[\x00\t\x0b-\r\x1c-\x1f\x85\xa0İŉɐ-\U0010ffff]")
_SPACES = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]")
#: Letters that Unicode composition leaves alone and lower-casing maps one to one.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ɏ"
_WORD = re.compile(f" ?[{_LETTERS}]+")
#: Letters, and the marks behind them: a place that both tokenizers split at.
_TAILED = re.compile(f"([{_LETTERS}]+)([!-/:-@\\[-`{{-~]+)")
#: A comma or full stop at a word's end that doesn't follow a letter or digit.
_LOOSE = re.compile(f"[,.](?<![{_LETTERS}0-9][,.])(?:[ \n]|$)")


def _usual(text: str) -> bool:
    """No match of _ODD, found faster where all is printable Latin-1."""
    if text.replace("\n", "").isprintable():
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            pass
    return not _ODD.search(text)


class WordEncoder:
    """encode(texts) gives the same ids as the tokenizer, as little-endian uint32 bytes.

    Both supported tokenizers split a text where a non-space is followed by white space, and between a letter or digit
    and a closing comma or full stop; no merge crosses such a place, so cached ids of the parts can be joined.
    Texts with unusual white space or a literal added token go to the tokenizer whole. The cache has two generations of max_words each: memory
    stays bounded whatever the vocabulary, and frequent words stay known.
    """

    def __init__(self, path: str, keeps_space: bool, max_words: int = 150_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # for parts, which are lower-cased and might spell an added token that their text does not
        self.split = Tokenizer.from_file(path)
        self.split.encode_special_tokens = True
        #: A text that holds one of these, literally, goes to the tokenizer whole, which gives its single id.
        self.added = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        # the same model, given whole words: what would be split or normalised otherwise is not sent there
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next" if keeps_space else "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tok.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if keeps_space else t.endswith("</w>"))]] = True
        self.keeps_space, self.max_words = keeps_space, max_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.split.encode_batch_fast(parts, add_special_tokens=False)]

    def _holds_added(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def spread(self, text: str) -> str | None:
        """A text of usual characters as the keys of its parts, with blanks between them; None for any other text."""
        if not text or not _usual(text) or _LOOSE.search(text) or self._holds_added(text):
            return None
        if not self.keeps_space:
            return text.lower().replace(", ", " , ").replace(". ", " . ").replace(",\n", " ,\n").replace(".\n", " .\n")
        if "  " in text or "\n " in text:
            return None
        # a part stands for a blank and itself, after \x00 for itself alone
        text = text.replace(", ", " \x00, ").replace(". ", " \x00. ")
        return text[1:] if text[0] == " " else "\x00" + text

    def parts(self, text: str) -> list[str] | None:
        """Keys of the parts of any other text; None: it has to be encoded whole."""
        if _SPACES.search(text) or "\x00" in text or self._holds_added(text):
            return None
        if not self.keeps_space:
            return text.split()
        if "  " in text or "\n " in text:
            return None
        first, *rest = text.split(" ")
        return ["\x00" + first, *rest] if first else rest

    def _text(self, part: str) -> str:
        return part if not self.keeps_space else part[1:] if part[:1] == "\x00" else " " + part

    def _learn(self, parts: list[str], group: int = 40) -> dict[str, bytes]:
        """Plain words are encoded in groups, and told apart by the tokens that can only begin or end a word."""
        import numpy as np

        plain, rest = [], []
        for p in parts:
            (plain if p.isalpha() and (p.isascii() or _WORD.fullmatch(p)) else rest).append(p)
        tailed = {p: (m[1], "\x00" + m[2] if self.keeps_space else m[2]) for p in rest if (m := _TAILED.fullmatch(p))}
        known = {x for pair in tailed.values() for x in pair}
        known = dict(zip(known, self._known(list(known)), strict=True)) if known else {}
        out = {p: known[a] + known[b] for p, (a, b) in tailed.items()}
        rest = [p for p in rest if p not in out]
        out.update(zip(rest, self._ids([self._text(p) for p in rest]), strict=True))
        groups = [plain[k : k + group] for k in range(0, len(plain), group)]
        joined = [" " + " ".join(g) if self.keeps_space else " ".join(g).lower() for g in groups]
        for g, e in zip(groups, self.bare.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.edge[ids])
            if len(at) == len(g):
                data, cuts = ids.tobytes(), [4 * x for x in ([*at.tolist(), len(ids)] if self.keeps_space else [0, *(at + 1).tolist()])]
                out.update((w, data[a:b]) for w, a, b in zip(g, cuts, cuts[1:], strict=False))
            else:
                out.update(zip(g, self._ids([self._text(p) for p in g]), strict=True))
        return out

    def _known(self, parts: list[str]) -> list[bytes]:
        """Of each part its ids, from the cache or learned."""
        found = list(map(self.young.get, parts))
        gaps = [i for i, x in enumerate(found) if x is None]
        if gaps:
            missing = list(dict.fromkeys([parts[i] for i in gaps]))
            old = list(map(self.old.get, missing))
            own = self._learn([p for p, x in zip(missing, old, strict=True) if x is None])
            own.update((p, x) for p, x in zip(missing, old, strict=True) if x is not None)
            for i in gaps:
                found[i] = own[parts[i]]
            if len(self.young) + len(own) > self.max_words:
                self.old, self.young = self.young, {}
            self.young.update(own)
            for p in [p for p in own if len(p) > 40]:
                del self.young[p]
        return found

    def _together(self, spread: list[str]) -> list[bytes]:
        """Parts of many texts are numbered by Arrow, so that each different one is looked up once."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pa.array(spread, pa.string())
        lists = pc.split_pattern(texts, " ") if self.keeps_space else pc.ascii_split_whitespace(texts)
        numbered = lists.flatten().dictionary_encode()
        ids_of = self._known(numbered.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids_of), np.int32, len(ids_of)) // 4
        pool, begins = np.frombuffer(b"".join(ids_of), "<u4"), np.cumsum(sizes, dtype=np.int32) - sizes
        part = numbered.indices.to_numpy()
        n = sizes[part]
        ends = np.cumsum(n)
        kind = np.int32 if len(ends) and ends[-1] < 1 << 31 else np.int64
        at = np.repeat(begins[part] - (ends - n).astype(kind), n)
        at += np.arange(len(at), dtype=kind)
        data = memoryview(pool[at].tobytes())
        cuts = (4 * np.concatenate([[0], ends]))[lists.offsets.to_numpy()].tolist()
        return [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        spread = [self.spread(t) for t in texts]
        usual = iter(self._together([s for s in spread if s is not None]))
        out = []
        for text, s in zip(texts, spread, strict=True):
            if s is not None:
                out.append(next(usual))
            elif (own := self.parts(text)) is None:
                out.append(array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(self._known(own)))
        return out

    def stream(self, batches: Iterable, chars: int = 16_000_000) -> Iterable[tuple]:
        """(row id, ids) of batches of rows (id, text), a bounded amount of text at a time: the more at once, the fewer
        times a word is looked up."""
        rows: list = []
        texts: list[str] = []
        n = 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pandas(), strict=True):
                rows.append(row)
                texts.append(text)
                n += len(text)
                if n >= chars:
                    yield from zip(rows, self.encode(texts), strict=True)
                    rows, texts, n = [], [], 0
        if rows:
            yield from zip(rows, self.encode(texts), strict=True)


@cache
def encoder(path: str, keeps_space: bool, max_words: int = 150_000) -> WordEncoder:
    """One for each worker process: its cache serves all the tasks that the process runs."""
    return WordEncoder(path, keeps_space, max_words)
