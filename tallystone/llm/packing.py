"""Hierarchical multi-length packing of tokenised documents into windows of 512, 1024, 2048 and 4096 tokens.

Every partition packs its own documents, so nothing is shuffled. Documents are cut at whole windows of the largest size, and
what is left is routed by its length to the tier of the smallest context size that holds it. In rounds of ROUND_TOKENS every tier, the
largest first, is packed into windows of its own size: a window starts with the longest piece that waits in its tier, its gap
takes the largest pieces of shorter tiers that fit (the lowest tier: its own), and the last tokens of the gap are cut from a longer
piece, which falls to a shorter tier. Windows are always full. A tier whose pieces fill no more windows keeps them for the next round; what
a partition has left in the end goes to windows of falling powers of two. So nothing is ever padded. The windows of a round and
size are dealt to step groups of equal numbers of tokens by their attention cost, dearest first and back and forth, so
that the groups of a size take about equal time.

Defined cases: a null text is empty; an empty text has its end token only; each repeated row is packed as a document of
its own; a null doc_id is kept; a very long text is cut into many windows, in memory proportional to its length; an empty table
gives no pieces; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm.arrow_text import give_back

WINDOW, END_ID, TIERS, STEP = 4096, 2, (512, 1024, 2048, 4096), 16
#: Tokens that wait in a worker before windows are built, and words whose ids a worker keeps (twice as many at most).
ROUND_TOKENS, KEPT_WORDS = 1 << 20, 350_000
#: Documents that are encoded together.
DOCS = 512
#: White space to Python but not to the tokenizer, or the other way round: such texts are encoded whole.
_ODD = re.compile("[\x1c-\x1f\x85]")
#: Texts without these have the same ids in lower case, which the tokenizer makes anyway; only added tokens match raw text.
_WIDE = re.compile("[\u0130\u0250-\U0010ffff]")


#: The pre-tokenizer under which a run of letters is one piece and a run of other signs is one piece.
_LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _byte_letters() -> dict[int, int]:
    """How byte-level pre-tokenizers write bytes as letters: printable ones as they are, all others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}


class _Kept(dict):
    """The ids of words, made when first asked for. At most limit words and as many of the generation before are kept, none
    of over 64 letters."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.older = make, max(limit, 1), {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.older = self.copy()
                self.clear()
            self[word] = found
        return found


class Encoder:
    """Token ids as little-endian 32-bit bytes; the ids of words between white space are kept and joined."""

    def __init__(self, path: str, end_id: int = END_ID, kept_words: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.end = Tokenizer.from_file(path), end_id.to_bytes(4, "little")
        spec = json.loads(self.model.to_str())
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.lowers = "Lowercase" in kinds
        added = {x["content"].lower() for x in spec.get("added_tokens") or [] if x["content"]}
        self.added = re.compile("|".join(map(re.escape, sorted(added)))) if added else None
        # letters can go to the model as they are where the steps before it are known to leave a run of them alone
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _LETTER_RUNS} and not steps[1]["add_prefix_space"]
        self.bytes, self.pieces = _byte_letters(), self.model.model.tokenize
        self.kept = _Kept(self._word, kept_words)

    def _whole(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        letters = word.rstrip(_SIGNS)
        if not (self.plain and letters.isalpha() and letters.islower() and (letters.isascii() or not _WIDE.search(letters))):
            return self._whole(word)
        if letters != word:
            return self.kept[letters] + self.kept[word[len(letters) :]]
        seen = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.pieces(seen)]).tobytes()

    def _words(self, text: str) -> list[str] | None:
        if _ODD.search(text):
            return None
        if not self.lowers or not text.isascii() and _WIDE.search(text):
            return text.split()
        lower = text.lower()
        if self.added and self.added.search(lower):  # words with an added token stand as they are
            return [w if self.added.search(low) else low for w in text.split() for low in [w.lower()]]
        return lower.split()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text with the end token."""
        ids = self.kept.__getitem__
        split = ((t, self._words(t)) for t in texts)
        return [(b"".join(map(ids, w)) if w is not None else self._whole(t)) + self.end for t, w in split]


class Packer:
    """Packs the documents of one partition. add() and finish() return rows
    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group)."""

    def __init__(self, base: int, window: int = WINDOW, tiers=TIERS, step: int = STEP, round_tokens: int = ROUND_TOKENS):
        self.window, self.tiers, self.step, self.round_tokens = window, sorted(tiers), step, round_tokens
        self.ids, self.groups, self.order = count(base), count(base), count()
        self.waiting: list[list] = [[] for _ in self.tiers]  # by tier: (length, order, doc_id, start, doc_tokens, bytes), sorted
        self.whole: list[list] = []  # windows of one piece
        self.tokens = 0  # that wait in tiers

    def _route(self, piece) -> None:
        tier = next(k for k, t in enumerate(self.tiers) if piece[0] <= t)
        bisect.insort(self.waiting[tier], piece, key=lambda p: p[:2])
        self.tokens += piece[0]

    def add(self, doc_id, data: bytes) -> list[tuple]:
        n, w = len(data) // 4, self.window
        whole = n // w * w
        self.whole += [[(w, 0, doc_id, s, n, data[4 * s : 4 * (s + w)])] for s in range(0, whole, w)]
        if n > whole:
            self._route((n - whole, next(self.order), doc_id, whole, n, data[4 * whole :]))
        return self._build() if self.tokens + len(self.whole) * w >= self.round_tokens else []

    def _take(self, room: int, below: int):
        """The longest piece of at most room tokens that waits in a tier below that number."""
        for pieces in reversed(self.waiting[:below]):
            if k := bisect.bisect_right(pieces, room, key=lambda p: p[0]):
                self.tokens -= pieces[k - 1][0]
                return pieces.pop(k - 1)
        return None

    def _cut(self, room: int, below: int):
        """The first room tokens of a longer piece, from the shortest tier below that number that has pieces."""
        pieces = next((p for p in self.waiting[:below] if p), None)
        if pieces is None:
            return None
        n, _, doc_id, start, total, data = pieces.pop()
        self.tokens -= n
        self._route((n - room, next(self.order), doc_id, start + room, total, data[4 * room :]))
        return room, 0, doc_id, start, total, data[: 4 * room]

    def _tier(self, k: int) -> list[list]:
        """Full windows of tier k, as many as its pieces and shorter ones fill."""
        windows = []
        while self.waiting[k]:
            inside, room = [], self.tiers[k]
            while room:
                if not inside:
                    piece = self._take(room, k + 1)  # the longest of this tier
                else:
                    piece = self._take(room, k or 1) or self._cut(room, k) or self._cut(room, k + 1)
                if piece is None:
                    break
                inside.append(piece)
                room -= piece[0]
            if room:
                for piece in inside:
                    self._route(piece)
                break
            windows.append(inside)
        return windows

    def _emit(self, windows: list[list], size: int) -> list[tuple]:
        """Windows of one size to rows, dealt to step groups of step * window tokens by their attention cost."""
        windows = sorted(windows, key=lambda w: -sum(p[0] * p[0] for p in w))
        in_group = max(1, self.step * self.window // size)
        groups = [next(self.groups) for _ in range(-(-len(windows) // in_group))]
        rows = []
        for k, inside in enumerate(windows):
            lap, at = divmod(k, len(groups))
            group, sequence, offset = groups[at if lap % 2 == 0 else -1 - at], next(self.ids), 0
            for n, _, doc_id, start, total, data in inside:
                rows.append((doc_id, start, n, zlib.crc32(data), total, sequence, offset, size, group))
                offset += n
        return rows

    def _build(self) -> list[tuple]:
        rows = []
        for k in reversed(range(len(self.tiers))):
            windows = self._tier(k)
            if k == len(self.tiers) - 1:
                windows, self.whole = windows + self.whole, []
            rows += self._emit(windows, self.tiers[k])
        return rows

    def finish(self) -> list[tuple]:
        rows, every = self._build(), len(self.tiers)
        while self.tokens:
            size = room = 1 << (min(self.tokens, self.window).bit_length() - 1)
            inside = []
            while room:
                inside.append(self._take(room, every) or self._cut(room, every))
                room -= inside[-1][0]
            rows += self._emit([inside], size)
        return rows


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", kept_words: int = KEPT_WORDS) -> DataFrame:
    """The pieces of all documents. tokenizer: a file for tokenizers, by default the public word_bpe_49k.json.

    kept_words: how many words' ids a worker keeps, twice at most; fewer take less memory and more time.
    """
    kind = docs.schema[id_col].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(x, T.LongType()) for x in names)])
    tiers = tuple(t for t in TIERS if t < window) + (window,)

    def run(batches):
        from pyspark import TaskContext

        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        encode, packer = Encoder(path, end_id, kept_words), Packer(TaskContext.get().partitionId() << 40, window, tiers)
        id_type = None

        def out(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=[id_col, *names])

        rows = []
        for batch in batches:
            id_type = batch.schema.field(0).type
            for start in range(0, batch.num_rows, DOCS):
                part = batch.slice(start, DOCS)
                for doc_id, data in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    rows += packer.add(doc_id, data)
                if len(rows) >= 50_000:
                    yield out(rows)
                    rows = []
            give_back()
        if id_type is not None and (rows := rows + packer.finish()):
            yield out(rows)

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
