"""Token ids of whole texts with the tokenizers library."""

from __future__ import annotations

import json
import os
import struct

import numpy as np

from candela.llm.memory import claim

DEFAULT = "word_bpe_49k.json"
#: Words that a worker remembers the ids of, in each of two generations.
KEEP = 900_000
#: What words are learnt without at their end. No apostrophe, which can begin a piece with letters.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Fixed value: the splitter of word_bpe_49k.json, whose matches have no white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LOADED: dict[str, Encoder] = {}


def path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ends_in_letter(word: bytes) -> bool:
    last = word.decode()[-1]
    return last.isalpha() and len(last.lower()) == 1


def _letters(word: bytes) -> bool:
    text = word.decode()
    return text.isalpha() and len(text.lower()) == len(text)


def by_words(file: dict) -> bool:
    """Whether words between ASCII white space can be encoded by themselves and in lower case, from a tokenizer's JSON.

    The normalizers listed here change nothing across a word's ends, and Lowercase is one of them; the splitter's
    pattern must leave white space out of its matches; the model marks words' ends; special tokens all begin with <|.
    """
    steps = file.get("normalizer") or {}
    steps = steps.get("normalizers", [steps])
    plain = [s for s in steps if s.get("type") in ("NFC", "Lowercase") or (s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " ")]
    split = file.get("pre_tokenizer") or {}
    split = (split.get("pretokenizers") or [split])[0]
    removes = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
    pattern = (split.get("pattern") or {}).get("Regex", "")
    model = file.get("model") or {}
    marked = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
    special = all(t["content"].startswith("<|") and not t.get("lstrip") and not t.get("rstrip") for t in file.get("added_tokens", ()))
    return len(plain) == len(steps) and any(s["type"] == "Lowercase" for s in steps) and removes and pattern == WORD_PATTERN and marked and special


class Encoder:
    """encode(texts): the tokenizer's own ids with add_special_tokens=False; `ids` is one more than the largest id.

    Where the file's normalizer and splitter work the same on each side of ASCII white space and see no case in ASCII letters, words are
    encoded by themselves and remembered: such files drop white space, lower letters before splitting and mark each piece's last id
    with </w>. by_words() tells from the file; any other file's texts go to the tokenizer as they are, as does a text with the
    opening of a special token.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            self.words = by_words(json.load(f))
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ids = max(vocabulary.values()) + 1
        self.last = np.zeros(self.ids, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words that the younger generation lacks; they are in it afterwards.

        What follows a word's last letter is a piece of its own, so words are learnt without it.
        """
        if len(self.young) + len(words) > KEEP:
            self.old, self.young = self.young, {}
        found, stems, young, old = {}, {}, self.young.get, self.old.get
        for w in words:
            ids = old(w)
            if ids is not None:
                found[w] = ids
                continue
            stem = w.rstrip(MARKS)
            if stem is not w and not (stem and (stem[-1:].isalpha() or _ends_in_letter(stem))):
                stem = w
            stems[w] = stem
        wanted = {x for w, x in stems.items() if young(x) is None and old(x) is None}
        tails = {w[len(x) :] for w, x in stems.items() if len(x) < len(w)} - self.tails.keys()
        self.tails.update(zip(tails, self._each(tails), strict=True))
        letters = [x for x in wanted if x.isalpha() or _letters(x)]
        learnt = dict(zip(letters, self._joined(letters), strict=True))
        others = wanted - learnt.keys()
        learnt.update(zip(others, self._each(others), strict=True))
        for w, x in stems.items():
            ids = learnt.get(x)
            if ids is None:
                ids = young(x)
            if ids is None:
                ids = old(x)
            found[w] = ids if len(x) == len(w) else ids + self.tails[w[len(x) :]]
        self.young.update(learnt)
        self.young.update(found)
        return found

    def _each(self, words) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _joined(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of letters alone, of which each ends in one word-ending id."""
        out = []
        for at in range(0, len(words), 512):
            own = words[at : at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(own).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(stops) != len(own):
                out += self._each(own)
                continue
            data, begin = ids.tobytes(), 0
            for end in stops:
                out.append(data[begin:end])
                begin = end
        return out

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def arrays(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one text's after another's, and how many each has.

        A call's different words are looked up once each, its words are their numbers.
        """
        if not self.words:
            parts = [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]
            return np.frombuffer(b"".join(parts), dtype="<u4"), _sizes(parts)
        if not texts:
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        import pyarrow as pa
        import pyarrow.compute as pc

        special = [i for i, x in enumerate(texts) if x and "<|" in x]
        plain = [x or "" for x in texts]
        for i in special:
            plain[i] = ""
        # Every text has a word at least: an empty one, if no other.
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(plain, pa.large_string())))
        ends = split.offsets.to_numpy()[1:].astype(np.int64)
        numbered = split.flatten().dictionary_encode()
        del split, plain
        words, number = numbered.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy()
        ids = list(map(self.young.get, words))
        gaps = [i for i, x in enumerate(ids) if x is None]
        missing = {words[i] for i in gaps if words[i]}
        found = self._learn(missing) if missing else {}
        for i in gaps:
            ids[i] = found[words[i]] if words[i] else b""
        if special:
            number = number.copy()
            number[ends[special] - 1] = np.arange(len(ids), len(ids) + len(special))
            ids += [self.pack(self.tokenizer.encode(texts[i], add_special_tokens=False).ids) for i in special]
        data, size = np.frombuffer(b"".join(ids), dtype="<u4"), _sizes(ids)
        own = size[number]
        after = np.cumsum(own)
        at = np.repeat((np.cumsum(size) - size)[number] - (after - own), own)
        at += np.arange(len(at))
        return data[at], np.diff(after[ends - 1], prepend=0)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, counts = self.arrays(texts)
        data, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _sizes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4


def encoder(file: str) -> Encoder:
    """One for each worker and file; workers serve many tasks."""
    claim("tokens", _LOADED.clear)
    if file not in _LOADED:
        _LOADED[file] = Encoder(file)
    return _LOADED[file]


def slices(pdf, chars: int = 4_000_000):
    """Parts of a frame with a column text, of about so many characters each."""
    size = pdf["text"].str.len().fillna(0).cumsum() // chars
    for _, part in pdf.groupby(size.to_numpy(), sort=True):
        yield part
