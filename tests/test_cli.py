import pytest

from quorbit.__main__ import main
from quorbit.sources import generate as G

DUMP = """&FCI NORB=4,NELEC=4,
&END
""" + "".join(f" 4.0 {i} {i} {i} {i}\n" for i in range(1, 5)) + "".join(f" -1.0 {i} {j} 0 0\n" for i, j in ((2, 1), (3, 2), (4, 3), (4, 1)))


def test_commands(spark, tmp_path):
    path = lambda x: str(tmp_path / x)
    (tmp_path / "dump").write_text(DUMP)
    (tmp_path / "alpha").write_text("".join(f"{x:04b}\n" for x in range(16) if x.bit_count() == 2))
    got = main(["tpb", "--fcidump", path("dump"), "--dets", path("alpha"), "--block", "20", "--tolerance", "1e-3", "--carryover", "6", "--out", path("out")], spark)
    assert got["energy"] == pytest.approx(-2.10274848, abs=1e-5)
    assert main(["gen-dets", "--alpha", path("alpha"), "--norb", "4", "--out", path("dets")], spark) == {"states": 36}
    again = main(["gdb", "--fcidump", path("dump"), "--dets", path("dets"), "--method", "lanczos", "--block", "30", "--tolerance", "1e-8"], spark)
    assert again["energy"] == pytest.approx(-2.10274848, abs=1e-7)
    (tmp_path / "ham").write_text("\n".join(G.bond_model([(0, 1), (1, 2)], 1.0, 2.0)))
    (tmp_path / "basis").write_text("001\n010\n100\n")
    chain = main(["caop", "--hamiltonian", path("ham"), "--basis", path("basis"), "--width", "3", "--tolerance", "1e-6", "--out", path("chain")], spark)
    assert chain["energy"] == pytest.approx(-(2**0.5), abs=1e-6)
    rows = main(["stat", "--wave", path("chain/wave"), "--hamiltonian", path("ham"), "--samples", "50", "--batches", "2", "--reference-energy", "-3"], spark)
    assert [r["external"] for r in rows["batches"]] == [0, 0]
    (tmp_path / "log").write_text('a stats: profile calculation_id=run batch_id=1 rank=0 host="n" children=4\n')
    assert main(["summarize", "--log", path("log"), "--profile-output", path("p"), "--rank-output", path("r")], spark) == {"diagnostics": 1}
    assert spark.read.csv(path("r"), header=True).first()["calculation_id"] == "run"
    with pytest.raises(ValueError, match="distinct"):
        main(["summarize", "--log", path("log"), "--profile-output", path("p"), "--rank-output", path("p")], spark)
