"""Nearest codewords of the extended binary Golay code (24 bits, 4096 codewords, distance 8).

Every 24-bit word has one codeword within distance 3, or six at distance 4. If two words differ
in one bit, one of them has odd weight and one codeword; that codeword is also among the nearest
of the other. So words at distance 0 or 1 always share a nearest codeword.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

# Fixed value: generator polynomial of the 23-bit code.
GENERATOR = 0b110001110101


def _checks() -> np.ndarray:
    """The 12 check bits of each 12-bit message: remainder of the polynomial, then parity."""
    message = np.arange(4096)
    rest = message << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ GENERATOR << (bit - 11), rest)
    word = message << 11 | rest
    return rest << 1 | np.bitwise_count(word) & 1


class Golay:
    def __init__(self):
        self.check = _checks()
        # By syndrome: message parts of the least errors that have it, and their number.
        self.leaders, self.count = np.zeros((4096, 6), np.int64), np.zeros(4096, np.int64)
        for weight in range(5):
            errors = np.array([sum(1 << i for i in c) for c in combinations(range(24), weight)])
            syndrome = self._syndrome(errors)
            new = self.count[syndrome] == 0
            for e, s in zip(errors[new].tolist(), syndrome[new].tolist()):
                self.leaders[s, self.count[s]] = e >> 12
                self.count[s] += 1

    def _syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.check[words >> 12] ^ words & 4095

    def nearest(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of six codeword indices, and which of them are there."""
        s = self._syndrome(words)
        return (words >> 12)[:, None] ^ self.leaders[s], np.arange(6) < self.count[s][:, None]
