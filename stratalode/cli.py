"""Console programs acclus, acens and dssens: a parameter file in, a GEOEAS file with labels out.

Without a parameter file a program writes one with defaults and ends. Run as python -m stratalode.cli acclus [file].
"""

from __future__ import annotations

import os
import sys
from argparse import ArgumentParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import Samples
from .functions.geometry import Search
from .operators.clusterers import accluster
from .operators.ensembles import DualSpace, RandomSubspace
from .operators.labels import recode
from .sources.geoeas import read_geoeas, write_geoeas
from .sources.parfiles import Line, parse, read_par, render, write_par

# The parameter files' lines, defaults and comments.
_INPUT, _OUTPUT = Line("datafile.dat", "file with the input dataset"), Line("outfile.out", "file for clustering output")
_VARIABLES = Line("3  4  5  6", "columns for variables (implicit nvar)")
_SAVE = Line("1    1", "save all reals? recode clusters? (0=No, 1=Yes)")
_APPEND = Line("1", "append output to input file? (0=No, 1=Yes)")
_NEAR, _ANGLES, _RANGES = Line("25", "number of nearest neighbors"), Line("0  0  0", "search anisotropy/ ang1, ang2, ang3"), Line("500 500 500", "range1, range2, range3")
_METHOD = Line("kmeans", "cluster method: one of `kmeans`, `gmm`, `hier`")
_FOUND, _FINAL = Line("0.001 0.999", "min and max proportion in found clustering"), Line("4  6", "final nclus, target nclus")
_CONSENSUS = Line("spec", "final consensus method, `spec`(tral), `hier`(archical) or `power` (iteration)")
PROGRAMS = {
    "acclus": (
        "ACCluster",
        {
            "DATA": [_INPUT, Line("1  2  0", "columns for x, y, z data"), _VARIABLES, _OUTPUT, _APPEND],
            "AC": [_NEAR, _ANGLES, _RANGES, _METHOD, Line("1", "autocorrelation metrics (0=None, 1=Morans, 2=Getis)"), Line("5", "number of clusters")],
        },
    ),
    "acens": (
        "ACEnsemble",
        {
            "DATA": [_INPUT, Line("0  1  2  0", "columns for dh, x, y, z data"), _VARIABLES, _OUTPUT, _SAVE, _APPEND],
            "AC": [_NEAR, _ANGLES, _RANGES, _METHOD, Line("1  2", "autocorrelation metrics (0=None, 1=Morans, 2=Getis)"), Line("0.5 0.5", "autocorrelation props")],
            "ENS": [Line("523151", "random seed"), Line("100", "num ensemble"), Line("-1", "min number of variables, -1 to use all"), _FINAL, Line("0.0 0.15", "min and max proportion to remove"), _FOUND, _CONSENSUS],
        },
    ),
    "dssens": (
        "DSSEnsemble",
        {
            "DATA": [_INPUT, Line("1  2  0", "columns for x, y, z data"), _VARIABLES, _OUTPUT, _SAVE, _APPEND, Line("1", "number of parallel processes")],
            "DSS": [_NEAR, Line("10", "number of neighbors taken at spatial search"), _ANGLES, _RANGES],
            "ENS": [Line("512671", "random seed"), Line("100", "number of clusterings to generate"), _FINAL, _FOUND, _CONSENSUS],
        },
    ),
}


def _numbers(words, kind=int):
    return [kind(w) for w in words]


def _samples(spark, data: list[list[str]], with_holes: bool):
    frame = read_geoeas(spark, data[0][0])
    names = [c for c in frame.columns if c != "_row"]
    places = _numbers(data[1])
    hole = places.pop(0) if with_holes else 0
    if min(places[:2]) < 1:
        raise ValueError("the columns of x and y must be over zero")
    pick = lambda numbers: tuple(names[n - 1] for n in numbers if n > 0)
    return frame, Samples(frame, pick(places[:3]), pick(_numbers(data[2])), "_row"), pick([hole])


def _finish(frame: DataFrame, append: bool, final: DataFrame, name: str, reals: DataFrame | None, short: str, path: str) -> None:
    out = frame if append else frame.select("_row")
    out = out.join(final.select(F.col("id").alias("_row"), F.col("cluster").alias(f"{name}_clusters")), "_row")
    if reals is not None:
        numbers = sorted(r["real"] for r in reals.select("real").distinct().collect())
        wide = reals.groupBy("id").pivot("real", numbers).agg(F.first("cluster"))
        out = out.join(wide.select(F.col("id").alias("_row"), *(F.col(str(n)).alias(f"{short}_real{n}") for n in numbers)), "_row")
    write_geoeas(out, path, "_row")


def run(program: str, text: str, spark: SparkSession) -> None:
    """Runs a program on the text of its parameter file; the output path becomes a folder with one text file."""
    _, sections = PROGRAMS[program]
    found = parse(text, list(sections))
    data = found["DATA"]
    frame, samples, hole = _samples(spark, data, program == "acens")
    if program == "acclus":
        ac = found["AC"]
        search = Search.of(_numbers(ac[1][:3], float) + _numbers(ac[2][:3], float))
        final = accluster(samples, int(ac[5][0]), ac[3][0], int(ac[4][0]), int(ac[0][0]), search)
        _finish(frame, data[4][0] == "1", final, "acc", None, "acc", data[3][0])
        return
    ens = found["ENS"]
    if program == "acens":
        ac = found["AC"]
        model = RandomSubspace(samples, nreal=int(ens[1][0]), near=int(ac[0][0]), seed=int(ens[0][0]), least=float(ens[5][0]), most=float(ens[5][1]), search=Search.of(_numbers(ac[1][:3], float) + _numbers(ac[2][:3], float)), holes=hole[0] if hole else None, least_variables=int(ens[2][0]), methods=(ac[3][0],), metrics=tuple(_numbers(ac[4])), shares=tuple(_numbers(ac[5], float)), least_removed=float(ens[4][0]), most_removed=float(ens[4][1]))
        final_k, target, method, short = int(ens[3][0]), int(ens[3][1]), ens[6][0], "acens"
    else:
        dss = found["DSS"]
        model = DualSpace(samples, nreal=int(ens[1][0]), near=int(dss[0][0]), seed=int(ens[0][0]), least=float(ens[3][0]), most=float(ens[3][1]), search=Search.of(_numbers(dss[2][:3], float) + _numbers(dss[3][:3], float)), take=int(dss[1][0]))
        final_k, target, method, short = int(ens[2][0]), int(ens[2][1]), ens[4][0], "dssen"
    model.fit(target)
    final = model.predict(final_k, method=method)
    reals = None
    if data[4][0] == "1":
        reals = model.labels
        if data[4][1] == "1":
            if target != final_k:
                raise ValueError("realisations can be recoded only to as many final clusters as they have")
            reals = recode(reals, final.withColumnRenamed("cluster", "base")).select("real", "id", "cluster")
    _finish(frame, data[5][0] == "1", final, short, reals, short, data[3][0])


def main(arguments: list[str] | None = None) -> int:
    parser = ArgumentParser(description=__doc__)
    parser.add_argument("program", choices=sorted(PROGRAMS))
    parser.add_argument("parfile", nargs="?")
    args = parser.parse_args(arguments)
    title, sections = PROGRAMS[args.program]
    if args.parfile is None:
        write_par(render(title, sections), f"{title.lower()}.par")
        return 0
    if not os.path.isfile(args.parfile):
        parser.error(f"{args.parfile} does not exist")
    run(args.program, read_par(args.parfile), SparkSession.builder.appName(f"stratalode-{args.program}").getOrCreate())
    return 0


if __name__ == "__main__":
    sys.exit(main())
