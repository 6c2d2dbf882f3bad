"""A feed-forward network of one hidden layer: sigmoid, then linear; kept as XML, trained by gradient descent in numpy."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from typing import NamedTuple

import numpy as np


class Network(NamedTuple):
    w1: np.ndarray  # hidden x in
    b1: np.ndarray
    w2: np.ndarray  # out x hidden
    b2: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w1.T + self.b1, -500, 500))) @ self.w2.T + self.b2


def read_xml(text: str) -> Network:
    """A saved network: connections between modules in, hidden0, out and bias, each with its list of weights."""
    found = {}
    for c in ET.fromstring(text).iter("FullConnection"):
        parameters = c.findtext("Parameters", "[]").strip()
        found[c.find("inmod").get("val"), c.find("outmod").get("val")] = np.array(json.loads(parameters))  # type: ignore[union-attr]
    b1, b2 = found["bias", "hidden0"], found["bias", "out"]
    return Network(found["in", "hidden0"].reshape(len(b1), -1), b1, found["hidden0", "out"].reshape(len(b2), -1), b2)


def write_xml(net: Network) -> str:
    root = ET.Element("Network")
    for a, b, w in (("bias", "out", net.b2), ("bias", "hidden0", net.b1), ("in", "hidden0", net.w1), ("hidden0", "out", net.w2)):
        c = ET.SubElement(root, "FullConnection")
        ET.SubElement(c, "inmod", val=a)
        ET.SubElement(c, "outmod", val=b)
        ET.SubElement(c, "Parameters").text = json.dumps(w.ravel().tolist())
    return ET.tostring(root, "unicode")


def train(x: np.ndarray, y: np.ndarray, hidden: int = 20, steps: int = 500, rate: float = 0.05, seed: int = 1) -> Network:
    """Least squares by Adam on all rows. Both classes weigh the same."""
    rng = np.random.default_rng(seed)
    net = [rng.normal(0, 0.3, (hidden, x.shape[1])), np.zeros(hidden), rng.normal(0, 0.3, (1, hidden)), np.full(1, 0.5)]
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))[:, None] / len(y)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in net]
    for step in range(1, steps + 1):
        h = 1 / (1 + np.exp(-(x @ net[0].T + net[1])))
        d = (h @ net[2].T + net[3] - y[:, None]) * weight
        dh = d @ net[2] * h * (1 - h)
        for p, g, (m, v) in zip(net, (dh.T @ x, dh.sum(axis=0), d.T @ h, d.sum(axis=0)), moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Network(*net)
