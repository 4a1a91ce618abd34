"""Texts on which the operators are tried."""

import random

WORDS = "the and of thing rest tion over ing blend stone lane mark note dry hill ever oak pine moss".split()


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(60)) for _ in range(n))


def edge_texts():
    """Nulls, empty and white texts, a very long one, copies, near copies, shared passages, odd characters."""
    base, passage = prose(1, 120), prose(2, 60)
    near = base.split()
    near[60] = "other"
    texts = [None, "", " \t\n\x0b ", "one", "One two  three", prose(3, 20_000), base, base, base, " ".join(near), base.upper()]
    texts += [prose(10 + i, 50) + " " + passage + "\n" + prose(40 + i, 30) for i in range(4)]
    texts += [
        "mail me.x+1@mail-1.example.com, or a@b.c_d@e.fg; call +1 (706) 555-3138 now 4111 1111 1111 1111 and 10.0.0.255 or 10.0.0.256",
        "é\u0301 İSTANBUL ΑΣ\x1cb\x85 It's 'S 12 3½ 😀 <|endoftext|>x \u00a0 nb\u00a0sp # * $", "x" * 3000, "5 " * 400, "+1 " * 50 + "+12345678901",
        "same line\nsame line\nother", "a b c a b c a b c", "@" * 500 + "a@b.co", "1.2.3.4.5.6.7.8", "word\u2028split\x0cform",
    ]
    return texts
