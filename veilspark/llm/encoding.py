"""Text to token ids with the tokenizers library, each distinct piece once per task.

A byte-level BPE with the usual pre-tokenizer never joins what lies on both sides of a single space
or line break between two characters that aren't white space, nor a letter or digit with the
punctuation after it. Texts are cut there by Arrow's functions, the distinct pieces are encoded by
the library, and the ids are gathered in numpy; a property test compares them with whole texts. A
text that holds an added token of the file (such as an end mark) is encoded as a whole, so it gets
the library's ids too.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space; a text with two of them side by side, or one at an end, is cut with more care.
_WHITE = r"\t-\r\x1c-\x1f \x{85}\p{Z}"
ODD = f"[{_WHITE}][{_WHITE}]|^[{_WHITE}]|[{_WHITE}]$"
SPACE = f"([^{_WHITE}]) ([^{_WHITE}])"
#: A letter or digit that any version of the character tables knows, then ASCII punctuation.
EDGE = r"([0-9A-Za-zÀ-ÖØ-öø-ɏ])([!-/:-@\[-`{-~])"
MARK = "\x01"
#: Distinct pieces that each of the two generations of a worker's memory holds.
KEEP = 600_000
#: Characters of the texts that are encoded together, and words that the library gets in one string.
TOGETHER, JOINED = 8 << 20, 200


class Encoder:
    """Encodes columns of texts by a byte-level BPE file."""

    def __init__(self, path: str, keep: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes that each id stands for: a token's name has a character for each.
        self.width = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self.keep = KEEP if keep is None else keep
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drops the pieces known so far, so that an idle worker holds no memory for them."""
        self.young, self.old = {}, {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        # the fast form keeps no offsets
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, words: list[str], gap: str) -> list[bytes]:
        """Ids of words of letters and digits with a space before each (gap " "), or nothing (gap "\\n")."""
        out = []
        lead = 0 if gap == " " else 1
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for i in range(0, len(groups), 64):
            some = groups[i : i + 64]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([gap + gap.join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.cumsum([(len(w) if w.isascii() else len(w.encode())) + 1 for w in group])
                at = np.cumsum(self.width[ids])
                last = np.searchsorted(at, ends)
                if len(at) <= last[-1] or not np.array_equal(at[last], ends):
                    out += self._whole([" " + w if gap == " " else w for w in group])
                    continue
                data, edge = ids.tobytes(), [0, *(4 * (last + 1)).tolist()]
                out += [data[a + 4 * lead : b] for a, b in zip(edge, edge[1:])]  # noqa: B905
        return out

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; those that follow a space begin with it."""
        young, old = self.young, self.old
        found = list(map(young.get, pieces))
        if None in found:
            kinds: tuple[list, list, list] = [], [], []
            for i, x in enumerate(found):
                if x is None:
                    p = pieces[i]
                    if (x := old.get(p)) is not None:
                        young[p] = found[i] = x
                    elif p[:1] == " ":
                        kinds[0 if p[1:].isalnum() else 2].append(i)
                    else:
                        kinds[1 if p.isalnum() else 2].append(i)
            fresh = [
                self._plain([pieces[i][1:] for i in kinds[0]], " "),
                self._plain([pieces[i] for i in kinds[1]], "\n"),
                self._whole([pieces[i] for i in kinds[2]]),
            ]
            for where, ids in zip(kinds, fresh, strict=True):
                for i, x in zip(where, ids, strict=True):
                    young[pieces[i]] = found[i] = x
            if len(young) > self.keep:
                self.old, self.young = young, {}
        return found  # type: ignore[return-value]

    def encode(self, column: pa.Array, together: int = TOGETHER) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text of a string column; null counts as empty."""
        out: list[bytes] = []
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(size), 0
        while first < len(column):
            last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + together, side="right"))
            last = max(first + 1, last)
            out += self._some(pc.fill_null(column.slice(first, last - first).cast(pa.large_string()), ""))
            first = last
        return out

    def _some(self, texts: pa.Array) -> list[bytes]:
        whole = pc.match_substring(texts, MARK)
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        odd = pc.and_not(pc.match_substring_regex(texts, ODD), whole)
        kind = whole.to_numpy(zero_copy_only=False) * 2 + odd.to_numpy(zero_copy_only=False)
        even = texts.filter(pa.array(kind == 0))
        cut = pc.replace_substring(pc.replace_substring(even, " ", MARK + " "), "\n", f"{MARK}\n{MARK}")
        done = [iter(self._cut(cut)) if len(cut) else iter(())]
        cut = texts.filter(odd)
        if len(cut):
            # neighbouring spaces share a character, so the second pass finds the rest
            for _ in range(2):
                cut = pc.replace_substring_regex(cut, SPACE, f"\\1{MARK} \\2")
        done.append(iter(self._cut(cut)) if len(cut) else iter(()))
        done.append(iter(self._whole(texts.filter(whole).to_pylist())))
        return [next(done[k]) for k in kind.tolist()]

    def _cut(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts with a MARK at each cut."""
        lists = pc.split_pattern(pc.replace_substring_regex(texts, EDGE, f"\\1{MARK}\\2"), MARK)
        edges = np.asarray(lists.offsets).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        values = self.ids_of(words.dictionary.to_pylist())
        index = np.asarray(words.indices)
        data = np.frombuffer(b"".join(values), "<u4")
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
        begins = np.cumsum(lengths) - lengths
        count = lengths[index]
        after = np.concatenate([[0], np.cumsum(count)])
        ids = data[np.repeat(begins[index] - after[:-1], count) + np.arange(after[-1])].tobytes()
        cuts = (4 * after[edges - edges[0]]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905


@functools.lru_cache(2)
def encoder(path: str, keep: int | None = None) -> Encoder:
    return Encoder(path, keep)
