"""Training of the tagger of pii.py in numpy: python -m engram.llm.pii_training OUT.npz TABLES...

Half of the labelled texts come from a bounded sample (SAMPLE distinct contents) of the given tables: rules
that know the sentences in which the sample's authors put personal data mark the mentions, and many names are
swapped for invented ones. The other half is made of the invented sentences of pii_invented.py, with names,
numbers and addresses of many countries and shapes, mixed with plain sentences of the sample. The rules are
used here only; pii.py never sees them. Each of WORKERS processes makes its own texts and gradients.
"""

import multiprocessing
import random
import re
import sys
import time

import numpy as np

from engram.llm import pii_invented
from engram.llm.pii import KINDS, N_CLASSES, N_TAGS, Tagger, encode, windows

SAMPLE, HIDDEN, STEPS, SIZE, WORKERS, SEED = 80_000, 32, 2600, 64, 8, 5

_END = r"(?:wick|hurst|bergen|stad|ette|iano|inski|mere|quay|aro|ovan|elund)"
_LAST = rf"[A-ZÀ-Þ][a-zà-ÿ]+{_END}(?:-[A-ZÀ-Þ][a-zà-ÿ]+{_END})?"
_CAPS = rf"[A-ZÀ-Þ]{{2,}}{_END.upper()}(?:-[A-ZÀ-Þ]{{2,}}{_END.upper()})?"
_TITLE = r"(?:Dr\.|Prof\.|Mr\.|Ms\.|Mrs\.|Herr|Frau|Sr\.|Sra\.|Mme|M\.)"
_GIVEN = r"[A-ZÀ-Þ][a-zà-ÿ]+"
NAME = re.compile(rf"(?<![\w.@-])(?:(?:{_TITLE} )?(?:{_GIVEN}|[A-ZÀ-Þ]\.)(?: [A-ZÀ-Þ]\.)? {_LAST}|{_TITLE} {_LAST}|{_CAPS}, {_GIVEN})(?![\w@])")
_DOT = r"(?:\.|\s?[(\[]dot[)\]]\s?| dot )"
EMAIL = re.compile(rf"(?:mailto:)?[A-Za-z0-9._+-]+(?:\s?[@＠]\s?|\s?[(\[]at[)\]]\s?| at )[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*?{_DOT}(?:example|test|invalid|com|net|org)\b(?:\.(?:example|test))?(?!:)", re.I)
ID = re.compile(r"(?<![\w-])(?:\d{6} ?- ?\d{7}|(?<=번호 )\d{13}|(?<=번호: )\d{13}|(?:9\d\d)([-. ]?)\d\d\1\d{4}|QQ[ -]?\d\d[ -]?\d\d[ -]?\d\d[ -]?[A-D])(?![\w-]|\.\d)", re.I)
_EXT = r"(?:(?:,? (?:ext\.?|x|extension|Durchwahl|poste|내선)\.? ?\d+)|x\d+)?"
PHONE = re.compile(
    rf"(?<![\w._-])(?<!ts=)(?:(?:\+|00(?=[1-9]))\d[\d ().-]{{8,}}\d|(?:1[ -])?\(\d{{3}}\) ?\d{{3}}-\d{{4}}|(?:1[ .-])?\d{{3}}([-. ])\d{{3}}\1\d{{4}}|0\d{{1,2}}[-. ]\d{{3,4}}[-. ]\d{{4}}|0\d(?:[ .]\d\d){{4}}|0\d{{3,4}} \d{{6}}|0\d{{2}}[/ ]\d{{5,}}(?:[- ]\d{{3}})?|\d{{10,11}}){_EXT}(?![\w-])"
)
_CITY = r"(?:[,\n] ?(?!please|and )[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)?(?: [A-Z]{2} \d{5}| \d{5})?)?"
_ROAD = r"(?:Street|St\.?|Avenue|Ave\.?|Lane|Blvd\.?|Close|Terrace|Road|Rd\.?|Drive|Dr\.?|Court|Way)"
CARRIED = tuple(
    re.compile(p, re.S)
    for p in (
        rf"Owner of this memory: .{{4,45}}?(?:{_END}|, [A-ZÀ-Þ][a-zà-ÿ]+), (?P<a>(?:Flat)?.{{6,80}}?\S)\.(?=\s|$)(?!\s?\n?[A-Z][a-z]+(?: [A-Z][a-z]+)? (?:[A-Z]{{2}} )?\d{{5}})",
        r"still listed under (?P<a>.{6,80}?)\.(?=\s|$)(?!\n[A-Z][a-z]+(?: [A-Z][a-z]+)? (?:[A-Z]{2} )?\d{5})",
        r"i live at (?P<a>.{6,90}?), please",
        r"The letter went to (?P<a>.{6,90}?) last week",
        r"Ship the spare disk to (?P<a>.{6,90}?) \(ask for",
        rf"Ansprechperson ist .{{4,45}}?(?:{_END}|, [A-ZÀ-Þ][a-zà-ÿ]+), (?P<a>.{{6,80}}?\d{{5}} [A-ZÄÖÜ]\w+)",
        rf"La responsable es .{{4,45}}?(?:{_END}|, [A-ZÀ-Þ][a-zà-ÿ]+), (?P<a>.{{6,80}}?\d{{5}} [A-ZÁÉ]\w+)",
        r"Adresse de livraison : (?P<a>.{6,90}?\d{5} [A-ZÀ-Þ][\w’-]+)",
        r"배송지: (?P<a>.{6,70}?)\.(?=\s|$)",
    )
)
STREET = re.compile(rf"(?<![\w.-])(?:Flat \d+, )?\d{{1,4}}[a-z]?,? (?:[A-Z]\w+ ){{1,3}}{_ROAD}(?![a-z])(?:, Apt \w+)?{_CITY}", re.I)
# Openings of sentences whose numbers and words only look like personal data.
DECOYS = re.compile(
    r"Part no\. \S+|Cursor \d+|Batch \S+[^.]*|Ticket PRC\S+[^.]*|Offsets [^.]*|Range \S+, ratio \S+|Build [\d-]+[^.]*|Checksum \S+|Event evt_\d+[^.]*|Version \d[\d.]* needs port \d+|ts=\d+|Bus line 12, [^.]*|Project Larkspur[^.]*|Section 12 Main Loop, step 5 Close Stream|Connect as [^.]*|Pull from \S+|Pinned \S+ and \S+|The decorator [^.]*|He wrote “@[^.]*|Vector Store sync[^.]*|(?:Monday|Tuesday|Wednesday|Thursday|Friday) Review and [^.]*"
)


def label(text: str) -> list[tuple[int, int, str]]:
    """Labelled spans of one content; earlier rules win where they overlap."""
    taken = bytearray(len(text))
    for m in DECOYS.finditer(text):
        taken[m.start() : m.end()] = b"\2" * (m.end() - m.start())
    out = []

    def add(a: int, b: int, kind: str) -> None:
        while b > a and text[b - 1] in " \n,;":
            b -= 1
        if b > a and not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            out.append((a, b, kind))

    for m in EMAIL.finditer(text):
        add(*m.span(), "email")
    for pattern in CARRIED:
        for m in pattern.finditer(text):
            a, b = m.span("a")
            if not NAME.match(text, a):
                add(a, b, "address")
    for m in STREET.finditer(text):
        add(*m.span(), "address")
    for m in ID.finditer(text):
        add(*m.span(), "id_number")
    for m in PHONE.finditer(text):
        if 8 <= sum(ch.isdigit() for ch in m.group()) <= 20:
            add(*m.span(), "phone")
    for m in NAME.finditer(text):
        add(*m.span(), "name")
    return sorted(out)


def invented(rng: random.Random) -> str:
    ends = ("", "", "son", "er", "i", "ov", "sen", "ez", "ard", "mann", "ley", "o", "ko", "a")
    return ("".join(rng.choice("bdfghjklmnprstvwz") + rng.choice(("a", "e", "i", "o", "u", "ar", "en", "il", "or")) for _ in range(rng.randint(1, 3))) + rng.choice(ends)).capitalize()


def varied(text: str, spans: list, rng: random.Random) -> tuple[str, list]:
    """The same content with some names swapped for invented ones."""
    parts, out, at, size = [], [], 0, 0
    for a, b, kind in spans:
        piece = text[a:b]
        if kind == "name" and rng.random() < 0.5:
            piece = re.sub(r"[A-ZÀ-Þ][a-zà-ÿ]{3,}(?![.\w])", lambda m: m.group() if m.group() in ("Herr", "Frau", "Prof") or rng.random() < 0.3 else invented(rng), piece)
            piece = re.sub(r"[A-ZÀ-Þ]{4,}", lambda m: invented(rng).upper() if rng.random() < 0.6 else m.group(), piece)
        parts += [text[at:a], piece]
        size += a - at
        out.append((size, size + len(piece), kind))
        size += len(piece)
        at = b
    return "".join([*parts, text[at:]]), out


def tags_of(length: int, spans: list) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for a, b, kind in spans:
        k = KINDS.index(kind)
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    return y


def drawn(texts: list[str], carriers: list[str], rng: random.Random):
    """Labelled windows without end, half of them from the tables' contents."""
    positive, negative = pii_invented.templates(False)
    while True:
        if rng.random() < 0.5:
            text = rng.choice(texts)
            spans = label(text)
            if not spans and not DECOYS.search(text) and rng.random() < 0.65:
                continue
            text, spans = varied(text, spans, rng)
        else:
            text, spans = pii_invented.example(positive, negative, carriers, rng)
        x, y = encode(text), tags_of(len(text), spans)
        for a, b in windows(len(text)):
            yield x[a:b], y[a:b]


def batches(texts: list[str], carriers: list[str], seed: int):
    """Batches of windows of like length, in random order."""
    rng = random.Random(seed)
    source = drawn(texts, carriers, rng)
    while True:
        pool = sorted((next(source) for _ in range(40 * SIZE)), key=lambda p: len(p[0]))
        cuts = list(range(0, len(pool), SIZE))
        rng.shuffle(cuts)
        for at in cuts:
            yield pool[at : at + SIZE]


class Trainer:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {
            "wx": rng.normal(0, 0.3, (2, N_CLASSES, 4 * h)),
            "wh": rng.normal(0, 1.0 / np.sqrt(h), (2, h, 4 * h)),
            "out": rng.normal(0, 0.2, (2 * h, N_TAGS)),
            "bias": np.zeros(N_TAGS),
            "trans": np.zeros((N_TAGS, N_TAGS)),
            "start": np.zeros(N_TAGS),
        }
        self.w["wx"][:, :, h : 2 * h] += 1.5  # remember by default
        for a in range(N_TAGS):
            for k in range(len(KINDS)):
                if a not in (1 + 2 * k, 2 + 2 * k):
                    self.w["trans"][a, 2 + 2 * k] = -30.0  # going on needs a beginning
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.m = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.t = 0

    def gradients(self, batch: list) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss per character, and gradients per window."""
        w, n, h = self.w, len(batch), HIDDEN
        lengths = np.array([len(x) for x, _ in batch])
        longest = int(lengths.max())
        x = np.zeros((2, longest, n), np.int64)
        y = np.zeros((longest, n), np.int64)
        back = np.zeros((longest, n), np.int64)
        for r, (a, b) in enumerate(batch):
            x[0, : len(a), r], x[1, : len(a), r], y[: len(a), r] = a, a[::-1], b
            back[: len(a), r] = np.arange(len(a) - 1, -1, -1)
        mask = (np.arange(longest)[:, None] < lengths).astype(np.float32)
        cols = np.arange(n)[None, :]
        hs = np.zeros((longest + 1, 2, n, h), np.float32)
        cs = np.zeros((longest + 1, 2, n, h), np.float32)
        zs = np.empty((longest, 2, n, 4 * h), np.float32)
        gs = np.empty((longest, 2, n, 3 * h), np.float32)
        us = np.empty((longest, 2, n, h), np.float32)
        qs = np.empty((longest, 2, n, h), np.float32)
        for t in range(longest):
            z = np.matmul(hs[t], w["wh"], out=zs[t])
            z[0] += w["wx"][0][x[0, t]]
            z[1] += w["wx"][1][x[1, t]]
            g = np.clip(z[:, :, : 3 * h] * 0.25 + 0.5, 0, 1, out=gs[t])
            u = us[t] = z[:, :, 3 * h :] / (1 + np.abs(z[:, :, 3 * h :]))
            c = cs[t + 1] = cs[t] * g[:, :, h : 2 * h] + g[:, :, :h] * u
            q = qs[t] = c / (1 + np.abs(c))
            hs[t + 1] = g[:, :, 2 * h :] * q
        fwd, bwd = hs[1:, 0], hs[1:, 1][back, cols]
        feats = np.concatenate([fwd, bwd], 2)
        e = feats @ w["out"] + w["bias"]
        loss, de, dtrans, dstart = self.crf(e, y, mask, lengths)
        scale = 1.0 / n
        de *= scale
        grads = {"trans": dtrans * scale, "start": dstart * scale, "out": np.einsum("tnf,tnk->fk", feats, de, optimize=True), "bias": de.sum((0, 1))}
        df = de @ w["out"].T
        dh_all = np.zeros((longest, 2, n, h), np.float32)
        dh_all[:, 0] = df[:, :, :h]
        rev = df[:, :, h:][back, cols] * mask[:, :, None]
        dh_all[:, 1] = rev
        dwx = np.zeros_like(w["wx"])
        dwh = np.zeros_like(w["wh"])
        dh = np.zeros((2, n, h), np.float32)
        dc = np.zeros((2, n, h), np.float32)
        dz = np.empty((longest, 2, n, 4 * h), np.float32)
        wht = w["wh"].transpose(0, 2, 1)
        for t in range(longest - 1, -1, -1):
            dh = dh + dh_all[t]
            g, u, q, c = gs[t], us[t], qs[t], cs[t + 1]
            d = dz[t]
            dc = dc + dh * g[:, :, 2 * h :] * (1 - np.abs(q)) ** 2
            d[:, :, 2 * h : 3 * h] = dh * q
            d[:, :, :h] = dc * u
            d[:, :, h : 2 * h] = dc * cs[t]
            d[:, :, : 3 * h] *= 0.25 * ((g > 0) & (g < 1))
            d[:, :, 3 * h :] = dc * g[:, :, :h] * (1 - np.abs(u)) ** 2
            dc = dc * g[:, :, h : 2 * h]
            dh = d @ wht
        for k in range(2):
            flat = dz[:, k].reshape(-1, 4 * h)
            dwh[k] = hs[:-1, k].reshape(-1, h).T @ flat
            ids = x[k].reshape(-1)
            order = np.argsort(ids, kind="stable")
            firsts = np.flatnonzero(np.diff(ids[order], prepend=-1))
            dwx[k][ids[order][firsts]] = np.add.reduceat(flat[order], firsts, axis=0)
        grads |= {"wx": dwx, "wh": dwh}
        return loss / float(lengths.sum()), grads

    def apply(self, grads: dict[str, np.ndarray], rate: float) -> None:
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 4.0 / (norm + 1e-9))
        self.t += 1
        for k, g in grads.items():
            g = g * clip
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            self.w[k] -= (rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)).astype(np.float32)

    def step(self, batch: list, rate: float) -> float:
        loss, grads = self.gradients(batch)
        self.apply(grads, rate)
        return loss

    def crf(self, e, y, mask, lengths):
        """Negative log-likelihood of the tags and its gradients, by the forward and backward sums."""
        longest, n, k = e.shape
        trans, start = self.w["trans"], self.w["start"]
        tmax = trans.max()
        et = np.exp(trans - tmax)
        alpha = np.empty_like(e)
        alpha[0] = start + e[0]
        for t in range(1, longest):
            top = alpha[t - 1].max(1, keepdims=True)
            new = np.log(np.exp(alpha[t - 1] - top) @ et + 1e-30) + top + tmax + e[t]
            alpha[t] = np.where(mask[t][:, None] > 0, new, alpha[t - 1])
        beta = np.zeros_like(e)
        for t in range(longest - 2, -1, -1):
            s = beta[t + 1] + e[t + 1]
            top = s.max(1, keepdims=True)
            new = np.log(np.exp(s - top) @ et.T + 1e-30) + top + tmax
            beta[t] = np.where(mask[t + 1][:, None] > 0, new, 0)
        top = alpha[-1].max(1)
        logz = np.log(np.exp(alpha[-1] - top[:, None]).sum(1)) + top
        post = np.exp(alpha + beta - logz[None, :, None]) * mask[:, :, None]
        pair_mask = mask[1:]
        left = np.exp(alpha[:-1] - alpha[:-1].max(2, keepdims=True))
        right = np.exp(beta[1:] + e[1:] + (alpha[:-1].max(2) - logz[None])[:, :, None] + tmax) * pair_mask[:, :, None]
        pairs = np.einsum("tni,tnj->ij", left, right, optimize=True) * et
        cols = np.arange(n)[None, :]
        rows = np.arange(longest)[:, None]
        de = post.copy()
        de[rows, cols, y] -= mask
        gold = np.zeros_like(trans)
        np.add.at(gold, (y[:-1].ravel(), y[1:].ravel()), pair_mask.ravel())
        dstart = post[0].sum(0)
        np.subtract.at(dstart, y[0], 1.0)
        score = (e[rows, cols, y] * mask).sum() + (trans[y[:-1], y[1:]] * pair_mask).sum() + start[y[0]].sum()
        return float(logz.sum() - score), de.astype(np.float32), (pairs - gold).astype(np.float32), dstart.astype(np.float32)


def counts_of(spans: list) -> dict:
    out = {}
    for *_, kind in spans:
        out[kind] = out.get(kind, 0) + 1
    return out


def measure(tagger: Tagger, labelled: list[tuple[str, list]], show: int = 0) -> dict[str, tuple[float, float]]:
    """Precision and recall by kind, of mentions that overlap a labelled one."""
    hit, said, true, wrong = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0), []
    right = dict.fromkeys(KINDS, 0)
    for (text, gold), found in zip(labelled, tagger.spans([t for t, _ in labelled]), strict=True):
        for a, b, k in found:
            said[k] += 1
            right[k] += any(k == k2 and a < b2 and a2 < b for a2, b2, k2 in gold)
        for a, b, k in gold:
            true[k] += 1
            hit[k] += any(k == k2 and a < b2 and a2 < b for a2, b2, k2 in found)
        if counts_of(gold) != counts_of(found):
            wrong.append((text, [(k, text[a:b]) for a, b, k in gold], [(k, text[a:b]) for a, b, k in found]))
    for w in wrong[:show]:
        g, f = set(w[1]), set(w[2])
        print("  label only", g - f, "| tagger only", f - g, flush=True)
    print("texts with other counts", len(wrong), "of", len(labelled), flush=True)
    return {k: (round(right[k] / max(said[k], 1), 4), round(hit[k] / max(true[k], 1), 4)) for k in KINDS}


def unseen(n: int, carriers: list[str], seed: int = 1) -> list[tuple[str, list]]:
    """Texts of templates that training leaves out."""
    rng, (positive, negative) = random.Random(seed), pii_invented.templates(True)
    return [pii_invented.example(positive, negative, carriers, rng) for _ in range(n)]


def read(folders: tuple[str, ...]) -> list[str]:
    import pyarrow.dataset as ds

    texts: set[str] = set()
    for place in (f"{folder}/{name}.parquet" for folder in folders for name in ("chunks", "chunk_data")):
        texts |= set(ds.dataset(place).to_table(["content"])["content"].drop_null().to_pylist())
    out = sorted(texts)
    random.Random(SEED).shuffle(out)
    return out[:SAMPLE]


def plain_sentences(texts: list[str]) -> list[str]:
    return [s for t in texts[:20_000] if not label(t) and not DECOYS.search(t) for s in re.split(r"(?<=[.!?]) |\n", t) if s.strip()]


def main(out: str, *folders: str) -> None:
    sample = read(folders)
    held, sample = [(t, label(t)) for t in sample[:3000]], sample[3000:]
    carriers = plain_sentences(sample)
    strange = unseen(2000, carriers)
    trainer, began = Trainer(), time.time()
    names = sorted(trainer.w)
    sizes = [trainer.w[k].size for k in names]
    total = sum(sizes)
    # of all processes: the weights, and gradients and loss of each
    shared = np.frombuffer(multiprocessing.RawArray("f", total), np.float32)
    slots = np.frombuffer(multiprocessing.RawArray("f", WORKERS * (total + 1)), np.float32).reshape(WORKERS, total + 1)
    go, done = multiprocessing.Barrier(WORKERS + 1), multiprocessing.Barrier(WORKERS + 1)

    def split(flat: np.ndarray) -> dict[str, np.ndarray]:
        return {k: part.reshape(trainer.w[k].shape) for k, part in zip(names, np.split(flat, np.cumsum(sizes)[:-1]), strict=True)}

    def work(n: int) -> None:
        mine, source = Trainer(), batches(sample, carriers, SEED * 100 + n)
        for _ in range(STEPS):
            batch = next(source)
            go.wait()
            mine.w = split(shared)
            loss, grads = mine.gradients(batch)
            slots[n, :total] = np.concatenate([grads[k].ravel() for k in names])
            slots[n, total] = loss
            done.wait()

    fork = multiprocessing.get_context("fork")
    workers = [fork.Process(target=work, args=(n,), daemon=True) for n in range(WORKERS)]
    for w in workers:
        w.start()
    for step in range(STEPS):
        shared[:] = np.concatenate([trainer.w[k].ravel() for k in names])
        go.wait()
        done.wait()
        rate = 0.008 * min(1, (step + 1) / 100) * (1 - step / STEPS) ** 0.9 + 1e-5
        trainer.apply(split(slots[:, :total].mean(0)), rate)
        if step % 100 == 0:
            print(step, round(float(slots[:, total].mean()), 5), round(time.time() - began), flush=True)
        if step % 400 == 399 or step == STEPS - 1:
            tagger = Tagger({k: v.astype(np.float16).astype(np.float32) for k, v in trainer.w.items()})
            print("contents of the tables", measure(tagger, held, 6), flush=True)
            print("unseen templates", measure(tagger, strange, 6), flush=True)
            np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in trainer.w.items()})


if __name__ == "__main__":
    main(*sys.argv[1:])
