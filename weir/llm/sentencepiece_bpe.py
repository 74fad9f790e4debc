"""SentencePiece BPE encoding by backtracking, and decoding.

A unit is encoded from left to right: Aho-Corasick gives the longest piece that starts at each character; the shorter
ones there are the pieces among its prefixes, which a table names. The longest is tried first, a piece may follow
another only if merging the two from characters again yields those two, and a position from which nothing fits is
marked in a bitfield and left by backtracking. Every prefix of a text has one encoding, so a position that failed once
has failed for good.

A text is cut into units before each run of U+2581, then between characters that no piece has side by side:
no merge can cross such a cut, so units are encoded alone and remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import inf

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import claim

SPACE = "▁"
#: Bytes of the words, and of the parts of words, that a worker remembers in one generation, and the number of pairs.
#: This bounds memory only: a full generation becomes the old one, whose words are taken over when they come again, and
#: the one before it goes.
WORD_BYTES, PART_BYTES = 36 << 20, 18 << 20
CACHE_PAIRS = 300_000
#: Bytes that Python needs for an entry beside its text: slots of the table, headers of its objects.
_ENTRY = 170
#: Characters of the texts that are encoded together; a longer text is a group of its own.
GROUP_CHARS = 1 << 19
#: Characters up to which a word of letters is encoded without cuts.
ONE_PART = 40


class Memory:
    """What was computed for a text, in two generations of bounded bytes."""

    def __init__(self, limit: int):
        self.limit = limit
        self.now: dict[str, str | tuple] = {}
        self.before: dict[str, str | tuple] = {}
        self.bytes = 0

    def put(self, key: str, value: str | tuple) -> None:
        self.bytes += _ENTRY + 2 * len(key) + (len(value) if isinstance(value, str) else 8 * len(value))
        if self.bytes > self.limit:
            self.before, self.now, self.bytes = self.now, {}, 0
        self.now[key] = value


class Encoder:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation, a dummy prefix, escaped white space and byte fallback are supported")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.piece = [p.piece for p in model.pieces]
        self.score = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == 1}
        self.cost = {p: -x for p, (x, _) in self.score.items()}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.value = {i: b for b, i in self.byte.items()}
        self.size = [len(p) for p in self.piece]
        self.last = [k - 1 for k in self.size]
        self.name = [str(i) for i in range(len(self.piece))]
        self.n = len(self.piece)
        #: For each piece the longest piece among its prefixes, or -1.
        self.shorter = [-1] * self.n
        for p, (_, i) in self.score.items():
            self.shorter[i] = next((self.score[p[:k]][1] for k in range(len(p) - 1, 0, -1) if p[:k] in self.score), -1)
        self.trie = ahocorasick.Automaton()
        for p, (_, i) in self.score.items():
            if len(p) > 1:
                self.trie.add_word(p, i)
        self.trie.make_automaton()
        self.single = {p: i for p, (_, i) in self.score.items() if len(p) == 1}
        #: The characters that some piece has right after a character.
        self.after: defaultdict[str, set[str]] = defaultdict(set)
        for p in self.score:
            for a, b in zip(p, p[1:]):
                self.after[a].add(b)
        self.pairs: dict[int, bool] = {}
        self.parts = Memory(PART_BYTES)
        self.words = Memory(WORD_BYTES)

    def merged(self, text: str) -> list[int]:
        """BPE by its definition: merge the adjacent pair of the best score, the leftmost of equal ones."""
        s, known = list(text), self.cost.get
        cost = [known(a + b, inf) for a, b in zip(s, s[1:])]
        while cost and (best := min(cost)) < inf:
            at = cost.index(best)
            s[at] += s[at + 1]
            del s[at + 1], cost[at]
            if at:
                cost[at - 1] = known(s[at - 1] + s[at], inf)
            if at < len(cost):
                cost[at] = known(s[at] + s[at + 1], inf)
        return [self.score[x][1] if x in self.score else -1 for x in s]

    def fits(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a, or begin a unit (a = -1)."""
        key = a * self.n + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            pair = [b] if a < 0 else [a, b]
            known = self.pairs[key] = self.merged("".join([self.piece[i] for i in pair])) == pair
        return known

    def part(self, text: str) -> tuple[int, ...]:
        """Encode a unit, all of whose characters are pieces."""
        n, many, size, last, shorter, pairs = len(text), self.n, self.size, self.last, self.shorter, self.pairs.get
        longest = list(map(self.single.__getitem__, text))
        for end, i in self.trie.iter(text):
            longest[end - last[i]] = i  # ends ascend, so the longest comes last
        out: list[int] = []
        failed = pos = 0
        before, t = -many, longest[0]
        while True:
            while t >= 0:
                if not failed or not failed >> (pos + size[t]) & 1:
                    fit = pairs(before + t)
                    if fit is None:
                        fit = self.fits(out[-1] if out else -1, t)
                    if fit:
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                pos += size[t]
                if pos == n:
                    return tuple(out)
                before, t = t * many, longest[pos]
            else:
                failed |= 1 << pos
                if not out:
                    raise AssertionError("no encoding")
                t = out.pop()
                pos -= size[t]
                before, t = (out[-1] if out else -1) * many, shorter[t]

    def cuts(self, text: str) -> list[int]:
        """Ends of the parts of a unit: no merge can cross them."""
        after = self.after
        cuts = [k for k, (a, b) in enumerate(zip(text, text[1:]), 1) if a not in after or b not in after[a]]
        cuts.append(len(text))
        return cuts

    def part_row(self, part: str) -> str:
        """The ids of a part as text, remembered. A KeyError: it is a character that is no piece."""
        if len(part) == 1:
            return self.name[self.single[part]]
        row = self.parts.now.get(part)
        if row is None:
            row = self.parts.before.get(part) or ",".join(map(self.name.__getitem__, self.part(part)))
            self.parts.put(part, row)
        return row

    def encode_unit(self, text: str) -> list[int]:
        """Encode a stretch of text, white space escaped, cutting it where no merge can cross."""
        ids: list[int] = []
        begin = 0
        for k in self.cuts(text):
            part = text[begin:k]
            begin = k
            if len(part) == 1 and part not in self.single:
                ids.extend(self.byte[b] for b in part.encode())
            else:
                ids.extend(map(int, self.part_row(part).split(",")))
        return ids

    def decode(self, ids) -> str:
        """What the library's decode(ids) gives: bytes joined to characters, the first white space dropped."""
        text = self._decode(ids)
        return text[1:] if text[:1] == " " else text

    def _decode(self, ids) -> str:
        if self.value.keys().isdisjoint(ids):
            return "".join(map(self.piece.__getitem__, ids)).replace(SPACE, " ")
        out, run = [], bytearray()
        for i in ids:
            b = self.value.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            out.append(self.piece[i])
        if run:
            out.append(run.decode(errors="replace"))
        return "".join(out).replace(SPACE, " ")

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for unit in units(text):
            ids.extend(self.encode_unit(unit))
        return ids

    def _row(self, ids: list[int] | tuple[int, ...], unit: str) -> str | tuple[str, str]:
        """A unit's ids as text, and what they decode to if that is not the unit."""
        back = self._decode(ids)
        joined = ",".join(map(self.name.__getitem__, ids))
        return joined if back == " " + unit else (joined, back[1:])

    def _whole(self, unit: str) -> tuple[int, ...] | list[int]:
        """Encode a unit that is taken for one part."""
        try:
            return self.part(SPACE + unit)
        except KeyError:  # some character is no piece
            return self.encode_unit(SPACE + unit)

    def rows(self, new: list[str]) -> dict[str, str | tuple[str, str]]:
        """The rows of units, remembered. Each step is taken for all units, so that its tables stay in a core's cache."""
        before, out = self.words.before, {}
        fresh, composed = [], []
        for unit in new:
            if (row := before.get(unit)) is not None:
                out[unit] = row
            elif SPACE in unit or len(unit) <= ONE_PART and unit.isalpha():  # letters seldom have cuts between them
                fresh.append(unit)
            else:
                composed.append(unit)
        cuts = [self.cuts(SPACE + unit) for unit in composed]
        simple = [unit for unit, c in zip(composed, cuts, strict=True) if len(c) == 1]
        # The first part of a unit is that of a unit of its own, which is remembered as such.
        now, heads = self.words.now, {unit[: c[0] - 1] for unit, c in zip(composed, cuts, strict=True) if len(c) > 1}
        known = {u: row for u in heads if (row := out.get(u) or now.get(u) or before.get(u)) is not None}
        fresh = list({*fresh, *simple, *(heads - known.keys())})
        ids = [self.encode_unit(SPACE + u) if SPACE in u or len(u) > ONE_PART else self._whole(u) for u in fresh]
        out.update(zip(fresh, map(self._row, ids, fresh), strict=True))
        known.update((u, out[u]) for u in heads - known.keys())
        for unit, c in zip(composed, cuts, strict=True):
            if len(c) > 1:
                text = SPACE + unit
                try:
                    out[unit] = ",".join([known[unit[: c[0] - 1]], *[self.part_row(text[a:b]) for a, b in zip(c, c[1:])]])
                except KeyError:
                    out[unit] = self._row(self.encode_unit(text), unit)
        for unit, row in out.items():
            self.words.put(unit, row)
        return out

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text (number of ids, the ids as text joined by commas, the text decoded from them)."""
        cut = [t.split(" ") if t and SPACE not in t and "  " not in t and t[0] != " " and t[-1] != " " else [u[1:] for u in units(t)] for t in texts]
        now = self.words.now
        new = self.rows([u for u in set().union(*cut) if u not in now])
        out = []
        for parts in cut:
            rows = list(map(now.get, parts))
            if None in rows:
                rows = [new[u] if r is None else r for u, r in zip(parts, rows, strict=True)]
            try:
                joined = ",".join(rows)
            except TypeError:  # some unit decodes to something else
                parts = [u if r.__class__ is str else r[1] for u, r in zip(parts, rows, strict=True)]
                joined = ",".join([r if r.__class__ is str else r[0] for r in rows])
            out.append((joined.count(",") + 1 if joined else 0, joined, " ".join(parts)))
        return out

    def digest(self, text: str) -> tuple[int, str, str]:
        return self.digests([text])[0]


def groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in their order, in lists that come to GROUP_CHARS or hold one text."""
    group, chars = [], 0
    for t in texts:
        if group and chars + len(t) > GROUP_CHARS:
            yield group
            group, chars = [], 0
        group.append(t)
        chars += len(t)
    if group:
        yield group


def units(text: str) -> list[str]:
    """The escaped text, dummy prefix included, cut before each run of U+2581."""
    return re.findall(f"{SPACE}+[^{SPACE}]*", (SPACE + text.replace(" ", SPACE)) if text else "")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per document: id_col, n_tokens, ids_sha256, decoded_sha256[, ids array<int>, decoded string].

    Ids and decoded text are those of the sentencepiece library for this model, without begin and end ids. Null
    counts as empty, which has no ids. Each row is encoded alone, so ids may repeat or be null and other columns
    may have any name. A long text is encoded whole; what a worker remembers between texts is bounded.
    """

    def run(batches):
        claim("pieces", encoder.cache_clear)
        enc = encoder(model_path)
        for batch in batches:
            n, a, b, full, back = [], [], [], [], []
            texts = (t.as_py() or "" for t in batch.column(1))
            for count, joined, decoded in (d for g in groups(texts) for d in enc.digests(g)):
                n.append(count)
                a.append(_sha(joined))
                b.append(_sha(decoded))
                if ids:
                    full.append([int(x) for x in joined.split(",")] if joined else [])
                    back.append(decoded)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(full, pa.list_(pa.int32())), pa.array(back, pa.string())] if ids else []), names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if ids else [])]
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
