"""Made-up prose for the tests."""

import random


def prose(seed: int, words: int, lines: int = 4) -> str:
    rnd = random.Random(seed)
    made = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8))) for _ in range(words)]
    step = max(1, words // lines)
    return "\n".join(" ".join(made[i : i + step]) + "." for i in range(0, words, step))
