"""Token files against the library as it is loaded, added tokens included."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from wattline.llm import token_files

JSON = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"


def odd_texts():
    rng = random.Random(5)
    parts = [END, END, "one", " two", "  ", "\n", "é漢🙂", " it's", "<|endof", "text|>", "<", ".", "12"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [END, END * 3, f"one two{END}three", f" {END} ", ""]


def test_added_tokens_are_the_library():
    own, library, texts = token_files.tokenizer(JSON), Tokenizer.from_file(JSON), odd_texts()
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_query_is_the_library(spark, tmp_path):
    library, texts = Tokenizer.from_file(JSON), odd_texts()[-300:]
    rows = [*enumerate(texts), (len(texts), None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in token_files.op3(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    start, want = 0, []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
