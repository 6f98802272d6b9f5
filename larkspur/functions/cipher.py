"""A format-preserving cipher of identifiers: a keyed bijection of words over 63 characters that keeps their length.

A word is a pair of numbers in the radix of its alphabet, its two halves, and ten rounds of a balanced Feistel network mix them: in each
round one half gets a keyed hash of the other added, modulo its size, so every round can be undone. What comes out may be
no identifier or a word that stays in plain text; it is enciphered again until it is neither (cycle walking), which is a
bijection too, on the words that are usable themselves.

Words that also have letters of other European scripts have a larger alphabet. What they become has such a letter too, so
it is never what a word of the 63 characters becomes.
"""

from __future__ import annotations

import functools
import hashlib

# The characters of an identifier, in this order as digits; rounds of the network.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
ROUNDS = 10
# Latin, Greek and Cyrillic letters besides, one code point each.
WIDE = ALPHABET + "".join(c for c in map(chr, [*range(0xAA, 0x250), *range(0x370, 0x530)]) if c.isalpha() and c.isidentifier())


class WordCipher:
    """Enciphers and deciphers words of an alphabet; reserved: words that no ciphertext may be."""

    def __init__(self, key: bytes, reserved: frozenset[str] = frozenset(), alphabet: str = ALPHABET):
        if len(key) < 16:
            raise ValueError("a key has 16 bytes or more")
        self.key, self.reserved, self.alphabet, self.radix = key, reserved, alphabet, len(alphabet)
        self.value = {c: i for i, c in enumerate(alphabet)}

    def takes(self, word: str) -> bool:
        """Whether every character of a word is one of the alphabet's."""
        return all(c in self.value for c in word)

    def usable(self, word: str) -> bool:
        """Whether a word is an identifier that doesn't stay in plain text, and in a larger alphabet not one of the smaller one."""
        return not word[0].isdigit() and word not in self.reserved and (self.radix == len(ALPHABET) or not word.isascii())

    def _mix(self, turn: int, n: int, half: int, size: int) -> int:
        # 16 bytes more than the half has, so that the remainder is even.
        need, out = (self.radix**size).bit_length() // 8 + 16, b""
        for block in range(-(-need // 64)):
            out += hashlib.blake2b(f"{turn}:{n}:{block}:{half}".encode(), key=self.key[:64]).digest()
        return int.from_bytes(out[:need], "big") % self.radix**size

    def _halves(self, word: str) -> tuple[int, int]:
        number = lambda s: functools.reduce(lambda a, c: a * self.radix + self.value[c], s, 0)
        u = len(word) // 2
        return number(word[:u]), number(word[u:])

    def _word(self, a: int, b: int, n: int) -> str:
        out = []
        for value, size in ((b, n - n // 2), (a, n // 2)):
            for _ in range(size):
                value, digit = divmod(value, self.radix)
                out.append(self.alphabet[digit])
        return "".join(reversed(out))

    def once(self, word: str) -> str:
        """The network's permutation of the words of one length."""
        n, (a, b) = len(word), self._halves(word)
        sizes = n // 2, n - n // 2
        for turn in range(ROUNDS):
            if turn % 2 == 0:
                a = (a + self._mix(turn, n, b, sizes[0])) % self.radix ** sizes[0]
            else:
                b = (b + self._mix(turn, n, a, sizes[1])) % self.radix ** sizes[1]
        return self._word(a, b, n)

    def back(self, word: str) -> str:
        """The inverse of `once`."""
        n, (a, b) = len(word), self._halves(word)
        sizes = n // 2, n - n // 2
        for turn in range(ROUNDS - 1, -1, -1):
            if turn % 2 == 0:
                a = (a - self._mix(turn, n, b, sizes[0])) % self.radix ** sizes[0]
            else:
                b = (b - self._mix(turn, n, a, sizes[1])) % self.radix ** sizes[1]
        return self._word(a, b, n)

    def _walk(self, word: str, step) -> str:
        if not word or not self.usable(word):
            raise ValueError("only usable words are enciphered")
        word = step(word)
        while not self.usable(word):
            word = step(word)
        return word

    def encrypt(self, word: str) -> str:
        return self._walk(word, self.once)

    def decrypt(self, word: str) -> str:
        return self._walk(word, self.back)
