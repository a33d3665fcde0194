"""Small tables with the cases every operator has to take, and plain versions of shared steps."""

import functools
import os
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, size long, rep long, shard string, key string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ta", "ri", "mon", "sel", "ku", "ver", "dan", "ost"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


_LONG = prose(1, 6000)
DOCS = [
    (1, prose(10, 120), "en", "src0", 1),
    (2, prose(10, 120), "en", "src0", 1),  # an exact copy
    (3, prose(10, 120).upper() + " extra", "en", "src0", 1),  # a near copy, in upper case
    (4, None, None, None, None),
    (5, "", "de", "src1", 0),
    (6, "two words", "xx", "src1", 2),
    (7, _LONG, "en", "src0", 3),
    (8, _LONG[:20_000] + " " + prose(3, 40), "fr", "src0", 3),
    (9, prose(4, 400), "es", "src2", 4),
    (9, prose(4, 400), "es", "src2", 4),  # a repeated row
    (None, prose(5, 90), "en", "src2", 5),  # no id
    (12, "日本語 テキスト é́ \x85 \x1c\n\n \t" + prose(6, 60), "ja", "src3", 6),
    (13, "same same same same " * 40, "en", "src3", 7),
    (14, 'config token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + prose(7, 80), "en", "src3", 8),
]


def frame(spark, docs):
    """The table, with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*d, 7, -1, None, "x", "k") for d in docs], SCHEMA).repartition(3)


@functools.cache
def _tokenizer(name):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.encode_special_tokens = True
    return found


def brute_ids(name, text):
    return _tokenizer(name).encode(text or "", add_special_tokens=False).ids


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")
