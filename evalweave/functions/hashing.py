"""Hashes of word n-grams over whole Arrow batches, for tasks of ``mapInArrow``.

The functions are made inside ``gram_hasher``, so they travel with the job: executors need not have the package installed.
"""

from __future__ import annotations

import string


def gram_hasher(n: int, fold: bool = False):
    """A function from texts (no null) to (words, hashes, row, place).

    ``words`` are those of every text, as ``functions.text.words`` cuts them, after ``ascii_fold`` if ``fold``; ``hashes`` has a
    64-bit number for each n-gram that lies within one text, ``row`` and ``place`` the text and the word it begins at. A word is
    a polynomial of its bytes, an n-gram a sum of its words' numbers, each times an odd number of its own.
    """
    lower = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
    punctuation = string.punctuation.encode()

    def mix(h):
        import numpy as np

        for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(32))

    def factors(base, count):
        import numpy as np

        out = np.full(count, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    def word_numbers(words):
        import numpy as np

        raw = np.frombuffer((" ".join(words) + " ").encode(), np.uint8)
        ends = np.flatnonzero(raw == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        lengths = ends - starts + 1
        # The blank behind a word counts too, so no slice is empty.
        offset = np.arange(len(raw)) - np.repeat(starts, lengths)
        return mix(np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * factors(0x9E3779B97F4A7C15, int(lengths.max()))[offset], starts))

    def run(texts):
        import numpy as np

        if fold:
            texts = [t.encode().translate(lower, punctuation).decode() for t in texts]
        words = [t.split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        grams = np.maximum(sizes - (n - 1), 0)
        row = np.repeat(np.arange(len(words)), grams)
        place = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams)
        if not len(row):
            return words, np.zeros(0, np.uint64), row, place
        numbers = word_numbers([w for of_text in words for w in of_text])
        k = len(numbers) - (n - 1)
        sums = np.zeros(k, np.uint64)
        for j, factor in enumerate(factors(0xD6E8FEB86659FD93, n)):
            sums += numbers[j : j + k] * factor
        return words, mix(sums[(np.cumsum(sizes) - sizes)[row] + place]), row, place

    return run


def text_slices(limit: int):
    """A function from an Arrow batch to slices of about ``limit`` bytes of one string column (at least one row each)."""

    def run(batch, column: int):
        import numpy as np
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)

    return run
