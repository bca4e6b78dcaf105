"""Model inputs, and a predictor on Arrow batches with a stand-in for the model."""

import numpy as np
import pytest

from peakloom.operators import library, predict


@pytest.mark.parametrize(
    ("modseq", "expected"),
    [
        ("AM(UniMod:35)KMR", {(2, "O"): 1}),
        ("M(UniMod:35)PEPTIDE", {(1, "O"): 1}),
        ("PEPTIDEC(UniMod:4)", {(8, "C"): 2, (8, "H"): 3, (8, "N"): 1, (8, "O"): 1}),
        (".(UniMod:1)ACEPTIDE", {(0, "C"): 2, (0, "H"): 2, (0, "O"): 1}),
        ("PEPTIDEK(UniMod:1)", {(8, "C"): 2, (8, "H"): 2, (8, "O"): 1}),
        ("SM(UniMod:35)TM(UniMod:35)YK", {(2, "O"): 1, (4, "O"): 1}),
        ("S(UniMod:21)PYTK", {(1, "H"): 1, (1, "O"): 3, (1, "P"): 1}),
    ],
)
def test_inputs(modseq, expected):
    x = predict.inputs([modseq])
    n = len(predict.parts(modseq)[0])
    assert x.mods.shape == (1, n + 2, 109) and x.residues.shape == (1, n + 2)
    got = {(int(p), predict.MOD_ELEMENTS[e]): float(x.mods[0, p, e]) for p, e in zip(*np.nonzero(x.mods[0]), strict=True)}
    assert got == expected and x.residues[0, 0] == x.residues[0, -1] == 0 and x.residues[0, 1] == ord(predict.parts(modseq)[0][0]) - 64


def test_vocabulary():
    assert len(predict.MOD_ELEMENTS) == 109 and predict.element_index("Xx") == 108 and predict.element_index("C") == 0
    with pytest.raises(ValueError):
        predict.inputs(["AK", "AAK"])
    with pytest.raises(ValueError):
        predict.parts("a?")


def test_batched_predictor(spark):
    forms = spark.createDataFrame([("AM(UniMod:35)K", 2, "AMK", "P"), ("PEPTIDEK", 3, "PEPTIDEK", "P"), ("AMK", 2, "AMK", "P")], "modseq string, charge int, peptide string, protein string")

    def load():
        return lambda x, z: (x.mods.sum(axis=(1, 2)), 300 + z, [np.linspace(0, 1, (x.residues.shape[1] - 3) * 8) for _ in z])

    got = {r["modseq"]: r for r in predict.batched(forms, load).collect()}
    assert got["AM(UniMod:35)K"]["rt"] == 1 and got["AMK"]["rt"] == 0 and len(got["PEPTIDEK"]["ms2"]) == 56
    assert library.assemble(forms, lambda f: predict.batched(f, load)).count() > 10


def number(n):
    """A protocol buffer's variable-length whole number."""
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(k, value):
    if isinstance(value, int):
        return number(k << 3) + number(value)
    data = value.encode() if isinstance(value, str) else value
    return number(k << 3 | 2) + number(len(data)) + data


def tensor(name, kind, dims):
    shape = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in dims)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))


def node(kind, inputs, output, **lists):
    attributes = b"".join(field(5, field(1, k) + (field(20, 7) + b"".join(field(8, x) for x in v) if isinstance(v, list) else field(20, 2) + field(3, v))) for k, v in lists.items())
    return field(1, b"".join(field(1, x) for x in inputs) + field(2, output) + field(4, kind) + attributes)


def model(path, nodes, inputs, output, constants=()):
    """An ONNX file of a few nodes (operator set 9), written byte by byte."""
    values = b"".join(field(5, field(2, 1) + field(8, name) + field(9, np.array(v, np.float32).tobytes())) for name, v in constants)
    graph = b"".join(nodes) + field(2, "g") + values + b"".join(field(11, x) for x in inputs) + field(12, output)
    path.write_bytes(field(1, 4) + field(7, graph) + field(8, field(1, "") + field(2, 9)))
    return str(path)


def test_onnx_predictor(spark, tmp_path):
    """Retention time: the sum of all element counts. Section: the scaled charge. Intensities: the first elements' counts, and a half."""
    pytest.importorskip("onnxruntime")
    x, mods, z = tensor("x", 7, ["b", "n"]), tensor("mods", 1, ["b", "n", 109]), tensor("z", 1, ["b", 1])
    rt = model(tmp_path / "rt.onnx", [node("ReduceSum", ["mods"], "y", axes=[1, 2], keepdims=0)], [x, mods], tensor("y", 1, ["b"]))
    ccs = model(tmp_path / "ccs.onnx", [node("Identity", ["z"], "y")], [x, mods, z], tensor("y", 1, ["b", 1]))
    cut = node("Slice", ["mods"], "s", starts=[0, 0], ends=[-3, 8], axes=[1, 2])
    ms2 = model(tmp_path / "ms2.onnx", [cut, node("Add", ["s", "half"], "y")], [x, mods, z, tensor("e", 1, ["b", 1]), tensor("i", 7, ["b"])], tensor("y", 1, ["b", "m", 8]), [("half", 0.5)])
    forms = spark.createDataFrame([("AM(UniMod:35)KAA", 2, "AMKAA", "P"), ("PEPTIDEC(UniMod:4)K", 3, "PEPTIDECK", "P")], "modseq string, charge int, peptide string, protein string")
    got = {r["modseq"]: r for r in predict.onnx_predictor(rt, ccs, ms2, 0.1, 0.01)(forms).collect()}
    a, b = got["AM(UniMod:35)KAA"], got["PEPTIDEC(UniMod:4)K"]
    assert (a["rt"], b["rt"]) == (1.0, 7.0) and a["ccs"] == pytest.approx(0.2) and b["ccs"] == pytest.approx(0.3)
    want = np.full((4, 8), 0.5)
    want[2, 3] += 1  # oxygen is the fourth element, the residue's place is behind the N-terminus
    want = (want / want.max()).ravel()
    want[0] = 0
    assert np.allclose(a["ms2"], want) and len(b["ms2"]) == 64
    assert library.assemble(forms, predict.onnx_predictor(rt, ccs, ms2, 0.1, 0.01)).count() > 10
