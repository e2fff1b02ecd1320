"""Token counts with a whole-token shortcut.

A word-level BPE never merges across pre-tokens, so a text's count is the sum over its pre-tokens.
Once, on the driver, the tokenizer itself is asked which strings of its vocabulary encode alone as
one token, and into which class (letter, digit, other, white space) it puts each character of a
plain alphabet. A task then splits texts by those classes, counts pre-tokens that are proven whole
as one, and has only the rest merged by the library, each spelling once. Where a character outside
the plain alphabet stands, what is around it up to white space goes to the library as it is: neither
normalisation nor pre-tokens reach across white space.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import others, utf8_bytes
from tidemark.shared import bounded_batches

#: Characters below this are asked about; combining marks, which change what stands before them, start above it.
PLAIN = 0x250
#: What the pre-tokenizer splits off first: these pieces and then runs of letters, single digits and runs of others.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Spellings that a task remembers, beside the whole tokens, and characters of the longest of them.
REMEMBERED, LONGEST = 300_000, 200


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest is numbered from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Shortcut:
    """What is proven about a tokenizer: whole tokens, character classes and special strings."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = model
        t, said = Tokenizer.from_str(model), json.loads(model)
        added = said.get("added_tokens") or []
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        simple = not any(x[k] for x in added for k in flags) and said.get("post_processor") is None
        pieces = {x for x in re.findall(r"'[a-z]+", json.dumps(said.get("pre_tokenizer")))}
        simple &= pieces == set(ENDINGS)
        self.specials = sorted((x["content"] for x in added), key=len, reverse=True)
        self.classes = self.ask_classes(t) if simple else {}
        self.whole = self.ask_whole(t, said["model"].get("end_of_word_suffix") or "") if simple else frozenset()

    @staticmethod
    def ask_classes(t) -> dict[str, str]:
        """Letters, digits, others and spaces of the alphabet; what behaves in another way is left out."""
        cut = lambda x: len(t.pre_tokenizer.pre_tokenize_str(x))
        out = {"letter": "", "digit": "", "other": "", "space": ""}
        for c in map(chr, range(PLAIN)):
            low = t.normalizer.normalize_str(c)
            if low == " " and cut(f"a{low}a") == 2 and cut(low) == 0:
                out["space"] += c
            elif low != c.lower() or len(low) != 1 or ord(low) >= PLAIN:
                continue
            elif cut(f"a{low}a") == 1:
                out["letter"] += c
            elif cut(f"!{low}!") == 1:
                out["other"] += c
            elif cut(low) == 1 and cut(low + low) == 2:
                out["digit"] += c
        return out

    @staticmethod
    def ask_whole(t, suffix: str) -> frozenset[str]:
        letters, asked = byte_letters(), {}
        for word, number in t.get_vocab().items():
            body = word.removesuffix(suffix) if word.endswith(suffix) else ""
            if body and all(c in letters for c in body):
                try:
                    asked[bytes(letters[c] for c in body).decode()] = number
                except UnicodeDecodeError:
                    continue
        texts = list(asked)
        coded = t.encode_batch(texts, add_special_tokens=False)
        return frozenset(x for x, e in zip(texts, coded, strict=True) if e.ids == [asked[x]])

    def counter(self):
        """A function from a list of texts to their token counts."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.model)
        coded = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        if not self.classes:
            return coded
        of = {k: "".join(map(re.escape, v)) for k, v in self.classes.items()}
        plain, gap = "".join(of.values()), of["space"]
        strange = re.compile(f"[^{plain}]").search
        foreign = re.compile(f"[^{gap}]+")
        pieces = re.compile(f"{'|'.join(ENDINGS)}|[{of['letter']}]+|[{of['digit']}]|[{of['other']}]+").findall
        special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        cost: dict[str, int] = dict.fromkeys(self.whole, 1)

        def cut(part: str) -> list[str]:
            """Pre-tokens of a text, and runs around characters outside the plain alphabet."""
            if not strange(part):
                return pieces(part.lower())
            runs: list[str] = []
            rest = foreign.sub(lambda m: m[0] if not strange(m[0]) else runs.append(m[0]) or " ", part)
            return pieces(rest.lower()) + runs

        def count(texts: list[str]) -> list[int]:
            out, waiting, missing = [0] * len(texts), [], set()
            for i, text in enumerate(texts):
                parts = special.split(text) if special and special.search(text) else [text]
                found = [p for part in parts for p in cut(part)]
                out[i] = len(parts) - 1
                missing |= set(found).difference(cost)
                waiting.append((i, found))
            rest = list(missing)
            new = dict(zip(rest, coded(rest), strict=True))
            for i, found in waiting:
                out[i] += sum(cost[p] if p in cost else new[p] for p in found)
            cost.update((p, n) for p, n in new.items() if len(p) <= LONGEST)
            if len(cost) > len(self.whole) + REMEMBERED:
                cost.clear()
                cost.update(dict.fromkeys(self.whole, 1))
            return out

        return count


def count_tokens(docs: DataFrame, tokenizer: str, *, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit), as the tokenizers library counts
    with the .json file of a tokenizer: special strings in a text are special tokens, none is added,
    nothing is cut or padded.

    Null and empty texts have no tokens; texts may be of any length and repeated rows count each for
    itself; an empty table stays empty. Columns of docs named as the results are replaced, in any case of letters. The
    tokenizer, a few MB of fixed size, is read on the driver and broadcast.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(Shortcut(Path(tokenizer).read_text(encoding="utf-8")))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = held.value.counter()
        for texts in batches:
            yield pd.Series(count([x or "" for x in texts]), dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(*others(docs, ["n_bytes", "n_tokens", "over_limit"]), utf8_bytes(F.col(text_col)).alias("n_bytes"), tokens(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
