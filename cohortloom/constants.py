"""Defaults for survey cohorts. All of them can be overridden by arguments."""

# They must equal what users of these survey tables rely on.
ID_COLUMN = "sample"
ROW_NUMBER_COLUMN = "sequence"
WAVE_COLUMNS = {"SDDSRVYR": "year", "Cycle": "cycle"}
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
RAW_FOLDER = "data/raw/"
RAW_FILES = ("nhanes_data_1.csv", "nhanes_data_2.csv")

OUTCOMES = ("CFDRIGHT", "CFDDS")
COVARIATES = ("Cycle", "RIDAGEYR", "RIAGENDR", "INDFMPIR", "DMDEDUC2", "RIDRETH1")
DROPPED_COLUMNS = ("SDDSRVYR", "INDHHINC", "INDHHIN2")
DEMOGRAPHICS = ("RIDAGEYR", "RIAGENDR", "INDFMPIR", "DMDEDUC2", "RIDRETH1")

EXPOSURE_CATEGORIES = (
    "cotinine", "diakyl", "dioxins", "furans", "heavy metals", "hydrocarbons", "nutrients", "pcbs",
    "perchlorate", "pesticides", "phenols", "phthalates", "phytoestrogens", "polybrominated ethers",
    "polyflourochemicals", "volatile compounds",
)

BLOCK_PATTERNS = {
    "heavy metals": ["LBX", "PB", "CD", "HG", "SE", "MN"],
    "pesticides": ["LBX", "DDE", "DDT", "HCH", "NAL", "PAR", "CYF", "DME"],
    "phenols": ["LBX", "BP", "PH", "TR", "BP3", "BPA"],
    "phthalates": ["LBX", "PHT", "MHP", "MBP", "MZP", "MOP", "MCH", "MOH"],
    "nutrients": ["LBX", "FOL", "B12", "VIC", "VID", "VIA", "VIE"],
    "cotinine": ["LBX", "COT"],
    "pcbs": ["LBX", "PCB"],
    "dioxins": ["LBX", "DIO", "PCD", "HXC"],
    "furans": ["LBX", "FUR", "PCP", "HXC"],
    "hydrocarbons": ["LBX", "PAH", "FLU", "PHE", "PYR"],
    "perchlorate": ["LBX", "PER", "SCN", "NIT"],
    "phytoestrogens": ["LBX", "EQU", "DAI", "GEN"],
    "polybrominated ethers": ["LBX", "PBD", "BDE"],
    "polyflourochemicals": ["LBX", "PFO", "PFH", "PFN", "PFD"],
    "volatile compounds": ["LBX", "VOC", "BEN", "TOL", "XYL"],
}

LOG2_OFFSET = 1e-10
MIN_VALID = 200
MAX_LEVELS = 10
MIN_LEVEL_ROWS = 200
MAX_ZERO_SHARE = 0.9
