import os
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parents[2])
sys.path[:0] = [REPO, str(Path(REPO, "tests"))]
os.environ["PYTHONPATH"] = REPO + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"
#: NULL, empty, blank, repeated and odd texts, with NULL and repeated ids.
ODD = [
    (1, "Hello, world. It's   2024!"),
    (1, "Hello, world. It's   2024!"),
    (2, None),
    (3, ""),
    (4, " \n\t \n"),
    (5, "a<|endoftext|> b <|startoftext|>c <|endoftext|>"),
    (6, "naïve Ça Straße ΣΊΣΥΦΟΣ e\u0301\u0301 ﬁn ² ½ x²y 日本語 한국어 😀👍🏽 \u200bzero"),
    (7, "odd\u2003 spaces\x1c!\x1c!\u00a0and \u2003x\u2003\u2003 y\x85z\r\nline  \u3000"),
    (8, "don't we'll I'M 'S they've''ll !!!??? $%&"),
    (9, "x" * 5000 + " " + "ab" * 3000),
    (10, "word " * 70_000),
    (None, "no id"),
    (None, None),
    (11, "\x00\x01 control \ufeff"),
    (12, "last \n\n  \n"),
]
