"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword of 15 bits (rows of a 16 x 16 Hadamard matrix without its constant
column, so any two codewords differ in 8 bits). Each bit has a binary classifier on hashed
character n-grams: the log ratio of the n-gram's frequency in the languages with and without the
bit, every language weighing the same. A sentence's bits are decoded to the codeword with the
least logistic loss; the softmax of the losses is the confidence, and a best codeword that is
hardly better than the second is ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 15
DIM = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Sentences that are handled at once.
CHUNK = 512


def _hadamard(n: int) -> np.ndarray:
    h = np.array([[1]])
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def codebook(classes: int) -> np.ndarray:
    if classes > BITS + 1:
        raise ValueError("too many classes for 15 bits")
    return _hadamard(BITS + 1)[:classes, 1:].astype(np.float32)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts and the text each belongs to; texts are padded by a blank."""
    whole = [f" {t} " for t in texts]
    sizes = np.array([len(t) for t in whole], dtype=np.int64)
    codes = np.frombuffer("".join(whole).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ids, owners, h = [], [], np.zeros(len(codes), dtype=np.uint64)
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)) & np.uint64(0xFFFFFFFFFFFF)
        inside = owner[:m] == owner[n - 1 :]
        mixed = (h ^ (h >> np.uint64(15))) * np.uint64(0x9E3779B1) ^ np.uint64(n * 0x85EB)
        ids.append(((mixed >> np.uint64(12)) % np.uint64(DIM)).astype(np.int64)[inside])
        owners.append(owner[:m][inside])
    return (np.concatenate(ids), np.concatenate(owners)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Ecoc:
    labels: list[str]
    weights: np.ndarray
    #: The numbers of the labels among all classes.
    classes: np.ndarray
    sharp: float = 8.0
    margin: float = 0.5

    def decide(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: index of the label, confidence, and whether the choice is ambiguous."""
        if not texts:
            return np.zeros(0, int), np.zeros(0), np.zeros(0, bool)
        if len(texts) > CHUNK:  # bounded memory, however many texts there are
            parts = [self.decide(texts[i : i + CHUNK]) for i in range(0, len(texts), CHUNK)]
            return tuple(np.concatenate(x) for x in zip(*parts))
        ids, owner = grams(texts)
        n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        order = np.argsort(owner, kind="stable")
        sums = np.zeros((len(texts), BITS))
        if len(ids):
            sorted_owner = owner[order]
            first = np.flatnonzero(np.r_[True, sorted_owner[1:] != sorted_owner[:-1]])
            sums[sorted_owner[first]] = np.add.reduceat(self.weights[ids[order]], first, axis=0)
        bits = sums / n[:, None] * self.sharp
        code = codebook(len(self.labels))
        loss = np.logaddexp(0, -bits[:, None, :] * code[None]).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        two = np.sort(loss, axis=1)[:, :2]
        return loss.argmin(axis=1), p.max(axis=1), (two[:, 1] - two[:, 0] < self.margin) if loss.shape[1] > 1 else np.zeros(len(texts), bool)


def counted(texts: list[str], y: np.ndarray, classes: int, model: Ecoc | None = None) -> np.ndarray:
    """N-gram counts (classes x DIM) of sentences of class ``y``; those that ``model`` contradicts are left out."""
    count = np.zeros((classes, DIM), np.int64)
    for i in range(0, len(texts), CHUNK):
        some, of = texts[i : i + CHUNK], y[i : i + CHUNK]
        ids, owner = grams(some)
        if model is not None:
            on = (model.classes[model.decide(some)[0]] == of)[owner]
            ids, owner = ids[on], owner[on]
        count += np.bincount(of[owner] * DIM + ids, minlength=classes * DIM).reshape(classes, DIM)
    return count


def model_from(count: np.ndarray, names: list[str]) -> Ecoc:
    """The binary classifiers of all bits, from the counts of the classes that have any."""
    classes = np.flatnonzero(count.sum(axis=1))
    count = count[classes].astype(np.float64)
    total = count.sum(axis=0) + 0.5
    base = total / total.sum()
    freq = (count + 50 * base) / (count.sum(axis=1, keepdims=True) + 50)
    code = codebook(len(classes))
    weights = np.zeros((DIM, BITS), np.float32)
    for b in range(BITS):
        up, down = code[:, b] > 0, code[:, b] < 0
        if up.any() and down.any():
            weights[:, b] = np.log(freq[up].mean(axis=0)) - np.log(freq[down].mean(axis=0))
    return Ecoc([names[c] for c in classes], weights, classes)


def fit(texts: list[str], labels: list[str], names: list[str], rounds: int = 2) -> Ecoc:
    """Fit on labelled sentences. Labels may be noisy: after the first round, sentences whose label is contradicted are left out."""
    y = np.array([names.index(x) for x in labels], np.int64)
    model = None
    for _ in range(rounds):
        model = model_from(counted(texts, y, len(names), model), names)
    return model
