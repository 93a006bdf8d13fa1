import random

SF_SMALL = "/root/testdata/sf0.001"
CLASHES = ["id", "key", "label", "n_words", "shingle", "labels", "__text", "chunk", "piece"]


def prose(seed: int, words: int, lines: int = 1) -> str:
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(["ka", "lo", "mi", "ten", "ru", "sa", "vor", "del"]) for _ in range(rnd.randint(1, 4))) for _ in range(words)]
    step = max(1, words // lines)
    return "\n".join(" ".join(out[i : i + step]) for i in range(0, words, step))
