"""Index members; further lists come from files, one symbol a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: members of the Australian indices of 20, 50, 100 and 200 companies in January 2026
ASX20 = [
    "ALL.AX", "ANZ.AX", "BHP.AX", "BXB.AX", "CBA.AX", "CSL.AX", "FMG.AX", "GMG.AX", "MQG.AX", "NAB.AX",
    "NST.AX", "QBE.AX", "RIO.AX", "SIG.AX", "TCL.AX", "TLS.AX", "WBC.AX", "WDS.AX", "WES.AX", "WOW.AX",
]
ASX50 = [
    "AIA.AX", "ALQ.AX", "ALL.AX", "ANZ.AX", "BHP.AX", "BSL.AX", "BXB.AX", "CBA.AX", "COH.AX", "COL.AX",
    "CPU.AX", "CSL.AX", "EVN.AX", "FPH.AX", "FMG.AX", "GMG.AX", "IAG.AX", "JHX.AX", "LNW.AX", "LYC.AX",
    "MQG.AX", "MPL.AX", "NAB.AX", "NEM.AX", "NST.AX", "ORI.AX", "ORG.AX", "PLS.AX", "PME.AX", "QAN.AX",
    "QBE.AX", "REA.AX", "RMD.AX", "RIO.AX", "SCG.AX", "SGH.AX", "SIG.AX", "S32.AX", "SGP.AX", "SUN.AX",
    "TCL.AX", "TLS.AX", "SOL.AX", "WES.AX", "WBC.AX", "WTC.AX", "WDS.AX", "WOW.AX", "XRO.AX", "YAL.AX",
]
ASX100 = [
    "A2M.AX", "AIA.AX", "ALD.AX", "ALQ.AX", "ALX.AX", "ALL.AX", "AMCDD.AX", "ANZ.AX", "APA.AX", "APE.AX",
    "ARG.AX", "ASX.AX", "AZJ.AX", "AFI.AX", "BEN.AX", "BHP.AX", "BSL.AX", "BXB.AX", "CAR.AX", "CBA.AX",
    "CDA.AX", "CHC.AX", "CGF.AX", "CMM.AX", "COH.AX", "COL.AX", "CPU.AX", "CSL.AX", "DXS.AX", "EDV.AX",
    "EVN.AX", "FPH.AX", "FMG.AX", "GMD.AX", "GMG.AX", "GPT.AX", "GGP.AX", "HVN.AX", "HUB.AX", "IGO.AX",
    "IFT.AX", "IAG.AX", "JHX.AX", "JBH.AX", "LNW.AX", "LTR.AX", "LYC.AX", "MQG.AX", "MPL.AX", "MCY.AX",
    "MEZ.AX", "MIN.AX", "MGR.AX", "NAB.AX", "NWL.AX", "NEM.AX", "NXT.AX", "NST.AX", "ORI.AX", "ORG.AX",
    "PRU.AX", "PLS.AX", "PME.AX", "QAN.AX", "QBE.AX", "QUB.AX", "RMS.AX", "RHC.AX", "REA.AX", "REH.AX",
    "RMD.AX", "RIO.AX", "SFR.AX", "STO.AX", "SCG.AX", "SEK.AX", "SGH.AX", "SIG.AX", "SHL.AX", "S32.AX",
    "SGP.AX", "SUN.AX", "TNE.AX", "TLS.AX", "TLC.AX", "TPG.AX", "TCL.AX", "VAU.AX", "VCX.AX", "SOL.AX",
    "WES.AX", "WGX.AX", "WBC.AX", "WHC.AX", "WTC.AX", "WDS.AX", "WOW.AX", "WOR.AX", "XRO.AX", "YAL.AX",
]
ASX200 = [
    "360.AX", "4DX.AX", "AAI.AX", "A2M.AX", "AFI.AX", "AGL.AX", "AIA.AX", "ALK.AX", "ALD.AX", "ALQ.AX",
    "ALX.AX", "AMCDD.AX", "AMP.AX", "ANN.AX", "ANZ.AX", "APA.AX", "APE.AX", "ARB.AX", "ARG.AX", "ASB.AX",
    "ASX.AX", "AUB.AX", "AZJ.AX", "BAP.AX", "BEN.AX", "BFL.AX", "BGL.AX", "BHP.AX", "BOQ.AX", "BPT.AX",
    "BRG.AX", "BSL.AX", "BXB.AX", "BWP.AX", "CAR.AX", "CBA.AX", "CDA.AX", "CEN.AX", "CGF.AX", "CHC.AX",
    "CIA.AX", "CIP.AX", "CLW.AX", "CMM.AX", "CNU.AX", "COL.AX", "CPU.AX", "CQR.AX", "CSC.AX", "CSL.AX",
    "CTD.AX", "CWY.AX", "CYL.AX", "DBI.AX", "DMP.AX", "DNL.AX", "DOW.AX", "DRO.AX", "DRR.AX", "DXS.AX",
    "DYL.AX", "EBO.AX", "EDV.AX", "EMR.AX", "EVN.AX", "EVT.AX", "FBU.AX", "FLT.AX", "FMG.AX", "FPH.AX",
    "FRW.AX", "GDG.AX", "GGP.AX", "GMD.AX", "GMG.AX", "GNE.AX", "GPT.AX", "GQG.AX", "GYG.AX", "HDN.AX",
    "HMC.AX", "HUB.AX", "HVN.AX", "IAG.AX", "IFT.AX", "IGO.AX", "IFL.AX", "ILU.AX", "INA.AX", "IPX.AX",
    "IRE.AX", "JDO.AX", "JBH.AX", "JHX.AX", "L1G.AX", "LLC.AX", "LNW.AX", "LOV.AX", "LSF.AX", "LTR.AX",
    "LYC.AX", "MAF.AX", "MAQ.AX", "MCY.AX", "MEZ.AX", "MFF.AX", "MIN.AX", "MGR.AX", "MND.AX", "MQG.AX",
    "MP1.AX", "MPL.AX", "MSB.AX", "MTS.AX", "MXT.AX", "NAB.AX", "NCK.AX", "NEC.AX", "NEU.AX", "NIC.AX",
    "NHC.AX", "NEM.AX", "NHF.AX", "NMT.AX", "NSR.AX", "NST.AX", "NWL.AX", "NWH.AX", "NXT.AX", "OBM.AX",
    "ORA.AX", "ORG.AX", "ORI.AX", "PDN.AX", "PDI.AX", "PGR.AX", "PLS.AX", "PME.AX", "PMV.AX", "PNI.AX",
    "PPT.AX", "PRN.AX", "PRU.AX", "PXA.AX", "QAN.AX", "QBE.AX", "QUB.AX", "REA.AX", "REG.AX", "REH.AX",
    "RGN.AX", "RHC.AX", "RIO.AX", "RMD.AX", "RMS.AX", "RRL.AX", "RSG.AX", "RWC.AX", "RYM.AX", "SCG.AX",
    "SDF.AX", "SEK.AX", "SFR.AX", "SGH.AX", "SGM.AX", "SGP.AX", "SHL.AX", "SIG.AX", "SMR.AX", "SNZ.AX",
    "SOL.AX", "SPK.AX", "S32.AX", "STO.AX", "SUN.AX", "SUL.AX", "TAH.AX", "TCL.AX", "TLC.AX", "TLS.AX",
    "TLX.AX", "TNE.AX", "TPG.AX", "TUA.AX", "TWE.AX", "VAU.AX", "VCX.AX", "VEA.AX", "VGN.AX", "VNT.AX",
    "VUL.AX", "WAF.AX", "WAM.AX", "WBC.AX", "WDS.AX", "WEB.AX", "WES.AX", "WGX.AX", "WHC.AX", "WOW.AX",
    "WOR.AX", "WPR.AX", "WTC.AX", "XRO.AX", "YAL.AX", "ZIM.AX", "ZIP.AX",
]
INDICES = {"asx20": ASX20, "asx50": ASX50, "asx100": ASX100, "asx200": ASX200}


def members(spark: SparkSession, files: dict[str, str] | None = None) -> DataFrame:
    """(index_name, ticker) of the built-in indices and of those whose symbols a file lists."""
    own = spark.createDataFrame([(name, s) for name, symbols in INDICES.items() for s in symbols], "index_name string, ticker string")
    for name, path in (files or {}).items():
        own = own.union(spark.read.text(path).filter("trim(value) <> ''").select(F.lit(name), F.trim("value")))
    return own


def chosen(bars: DataFrame, symbols: list[str] | str) -> DataFrame:
    """Bars of the symbols asked for: ``"all"``, one symbol or a list."""
    if symbols == "all":
        return bars
    asked = [symbols] if isinstance(symbols, str) else symbols
    return bars.join(bars.sparkSession.createDataFrame([(s,) for s in asked], "ticker string"), "ticker", "left_semi")


def absent(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """The symbols asked for that have no bars."""
    return bars.sparkSession.createDataFrame([(s,) for s in symbols], "ticker string").join(bars.select("ticker").distinct(), "ticker", "left_anti")
