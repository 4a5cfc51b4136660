import json

import numpy as np
import pytest

from gradus.sources import tensors
from gradus.sources.files import SourceError

from .conftest import plan


def save(path, arrays, cut=0, **wrong):
    head, data = {"__metadata__": {"format": "pt"}}, b""
    for name, (dtype, x) in arrays.items():
        raw = x.tobytes()
        head[name] = {"dtype": dtype, "shape": list(x.shape), "data_offsets": [len(data), len(data) + len(raw)]} | wrong.get(name, {})
        data += raw
    text = json.dumps(head).encode()
    path.write_bytes(len(text).to_bytes(8, "little") + text + data[: len(data) - cut])


def arrays():
    r = np.random.default_rng(1)
    a = r.normal(size=(300, 40)).astype("<f4")
    a[5, 7], a[6, :3], a[9, 9] = np.nan, np.inf, 0
    bf = r.normal(size=1000).astype("<f4")
    bf[:10] = 0
    return {
        "layer.0.lora_A.weight": ("F32", a), "layer.0.lora_B.weight": ("F16", np.zeros((40, 8), "<f2")), "layer.1.lora_B.weight": ("BF16", (bf.view("<u4") >> 16).astype("<u2")),
        "ids": ("I64", np.arange(-5, 60, dtype="<i8")), "none": ("F32", np.zeros((0, 4), "<f4")), "one": ("F64", np.array(-2.5)),
    }


@pytest.mark.parametrize("part", [1 << 26, 4096, 333])
def test_counts(spark, tmp_path, part):
    own = arrays()
    save(tmp_path / "m.safetensors", own)
    df = tensors.tensor_table(spark, str(tmp_path), part)
    rows = spark.read.format("tensors").option("part", part).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == (1 if part > 1 << 20 else rows.rdd.getNumPartitions()) and (part > 1 << 20 or rows.rdd.getNumPartitions() > 10)
    got = {r["name"]: r for r in df.collect()}
    assert set(got) == set(own) and "partial_sum" in plan(df)
    for name, (dtype, x) in own.items():
        x = (x.astype("<u4") << 16).view("<f4") if dtype == "BF16" else x
        x = x.astype(float).ravel()
        fine = x[np.isfinite(x)]
        r = got[name]
        assert (r["count"], r["non_finite"], r["non_zero"]) == (len(x), len(x) - len(fine), np.count_nonzero(x))
        if len(fine):
            assert r["least"] == fine.min() and r["most"] == fine.max() and r["norm"] == pytest.approx(np.linalg.norm(fine))
        else:
            assert r["least"] is None


def test_adapters(spark, tmp_path):
    own = arrays()
    save(tmp_path / "bad.safetensors", own)
    good = {n: (d, np.nan_to_num(x, posinf=1) if d == "F32" else x) for n, (d, x) in own.items()}
    save(tmp_path / "good.safetensors", good)
    save(tmp_path / "still.safetensors", {n: x for n, x in good.items() if ".1." not in n})
    save(tmp_path / "half.safetensors", {n: x for n, x in good.items() if "lora_B" not in n})
    got = {r["file"].rsplit("/", 1)[1]: r for r in tensors.adapter_summary(tensors.tensor_table(spark, str(tmp_path))).collect()}
    assert {n: (r["status"], r["learned"], r["tensors"], r["nonzero_second"]) for n, r in got.items()} == {
        "bad.safetensors": ("FAIL", True, 3, 1), "good.safetensors": ("PASS", True, 3, 1), "still.safetensors": ("PASS", False, 2, 0), "half.safetensors": ("FAIL", False, 1, 0)
    }


def test_broken_files(tmp_path):
    path = tmp_path / "m.safetensors"
    for wrong in ({"cut": 1}, {"ids": {"dtype": "Q4"}}, {"ids": {"shape": [9]}}, {"one": {"data_offsets": [0, 8]}}):
        save(path, arrays(), **wrong)
        with pytest.raises(SourceError):
            tensors.header(str(path))
    for raw in (b"", b"\1", (1 << 40).to_bytes(8, "little") + b"{}", (2).to_bytes(8, "little") + b"xx"):
        path.write_bytes(raw)
        with pytest.raises(SourceError):
            tensors.header(str(path))
    save(path, {})
    assert tensors.planned(str(path), 10) == []
