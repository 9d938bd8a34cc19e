"""Token counts with a whole-token shortcut.

``whole_tokens`` proves on the driver, with the tokenizer library itself, which vocabulary strings
encode alone as exactly one token. Texts are cut into pre-tokens by the byte-level pattern; a
pre-token in that set counts one, and only the rest is merged by the library, each distinct pre-token
once per worker as long as a bounded memo holds it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the byte-level pre-token pattern. White space is Unicode's White_Space.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Entries of a worker's memo of merged pre-tokens; it is emptied when full.
MEMO = 400_000
#: Longest pre-token the memo keeps, in characters.
MEMO_CHARS = 64
#: Characters of text whose pre-tokens are held at once.
BLOCK = 1 << 20


def whole_tokens(tokenizer) -> set[str]:
    """The vocabulary strings that, encoded alone, give one token and are one pre-token."""
    found = set()
    split = regex.compile(PATTERN)
    strings = [s for i in range(tokenizer.get_vocab_size()) if (s := tokenizer.decode([i], skip_special_tokens=False))]
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    for text, code in zip(strings, encoded):
        if len(code.ids) == 1 and text not in special and split.findall(text) == [text]:
            found.add(text)
    return found


class Counting:
    """Counts the tokens of texts; one for each Python worker."""

    def __init__(self, path: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = whole
        self.memo: dict[str, int] = {}
        self.pattern = regex.compile(PATTERN)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def counts(self, text: str) -> int:
        """Tokens of one text; special strings inside it are one token each."""
        if self.added is None:
            return self._plain(text)
        total, at = 0, 0
        for found in self.added.finditer(text):
            total += self._plain(text[at : found.start()]) + 1
            at = found.end()
        return total + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> int:
        total, block, held = 0, [], 0
        if len(text) <= BLOCK:
            return self._sum(Counter(self.pattern.findall(text)))
        for found in self.pattern.finditer(text):
            block.append(found[0])
            held += len(block[-1])
            if held >= BLOCK:
                total, block, held = total + self._sum(Counter(block)), [], 0
        return total + self._sum(Counter(block))

    def _sum(self, pieces: Counter) -> int:
        whole, memo, total, rest = self.whole, self.memo, 0, []
        for piece, times in pieces.items():
            if piece in whole:
                total += times
            elif (n := memo.get(piece)) is not None:
                total += n * times
            else:
                rest.append(piece)
        if rest:
            if len(memo) + len(rest) > MEMO:
                memo.clear()
            for piece, code in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
                n = len(code)
                total += n * pieces[piece]
                if len(piece) <= MEMO_CHARS:
                    memo[piece] = n
        return total


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``tokenizer_path`` names a byte-level BPE file of the tokenizers library, readable under that path
    wherever tasks run.

    Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each;
    null ids stay null; an empty table gives no rows; other columns are ignored.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(frozenset(whole_tokens(Tokenizer.from_file(tokenizer_path))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counting = Counting(tokenizer_path, whole.value)
        for batch in batches:
            tokens = [counting.counts(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
