"""Dimension tables: sites, sectors, capacities, circuits, shifts, valid paths. A few hundred rows at most, so broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: configuration of the three plants --------------------------------------------------------------

SITES = [("ricardone", "Ricardone"), ("san_lorenzo", "San Lorenzo"), ("avellaneda", "Avellaneda")]

CAPACITY = {
    "san_lorenzo": {"S0": 92, "S1": 2, "S2": 2, "S3": 13, "S4": 17, "S5": 14, "S6": 28, "S7": 14, "S8": 11, "S10": 11},
    "ricardone": {"S0": 28, "S1": 263, "S2": 39, "S3": 39, "S4": 14, "S5": 14, "S6": 141, "S7": 44, "S8": 44, "S9": 44, "S10": 44},
}

#: (site, code, other codes, name, kind, subkind, camera sequence) in catalog order.
CIRCUITS = [
    ("ricardone", "A1V0", ["A1"], "Celda 16", "recepcion", "solidos", None),
    ("ricardone", "A2V0", ["A2"], "Silo Australiano", "recepcion", "solidos", None),
    ("ricardone", "A3V0", ["A3"], "Silos Kepler", "recepcion", "solidos", None),
    ("ricardone", "A4V0", ["A4"], "Silos CHIEF", "recepcion", "solidos", None),
    ("ricardone", "A5V0", ["A5"], "Volcable 1", "recepcion", "solidos", None),
    ("ricardone", "A6V0", ["A6"], "Volcable 2", "recepcion", "solidos", None),
    ("ricardone", "A7V0", ["A7"], "San Lorenzo", "recepcion", "solidos", None),
    ("ricardone", "B1V0", ["B1"], "Celda 16", "despacho", "solidos", None),
    ("ricardone", "B2V0", ["B2"], "Silo Australiano", "despacho", "solidos", None),
    ("ricardone", "B3V0", ["B3"], "Silos Kepler", "despacho", "solidos", None),
    ("ricardone", "B4V0", ["B4"], "Silos CHIEF", "despacho", "solidos", None),
    ("ricardone", "B5V0", ["B5"], "Celda 9", "despacho", "solidos", None),
    ("ricardone", "B6V0", ["B6"], "Celda 10", "despacho", "solidos", None),
    ("ricardone", "B7V0", ["B7"], "Celda 11", "despacho", "solidos", None),
    ("ricardone", "B8V0", ["B8"], "San Lorenzo", "despacho", "solidos", None),
    ("ricardone", "C1V0", ["C1", "D1"], "Líquidos completo", "recepcion", "liquidos", None),
    ("ricardone", "E1V0", ["E1", "E01"], "Celda 16 -> Silo Australiano", "movimiento_interno", "transile", None),
    ("ricardone", "E2V0", ["E2", "E02"], "Silo Australiano -> Silos Kepler", "movimiento_interno", "transile", None),
    ("ricardone", "E3V0", ["E3", "E03"], "Silos Kepler -> Celda 16", "movimiento_interno", "transile", None),
    ("ricardone", "E4V0", ["E4", "F4"], "Mov. interno Celda 16 -> Silos Kepler", "movimiento_interno", "transile", None),
    ("ricardone", "E5V0", ["E5", "F5"], "Carga Silo Australiano", "movimiento_interno", "transile", None),
    ("san_lorenzo", "A1V0", ["A1"], "Completo", "recepcion", "solidos", "S0 S1 S3 S4 S5 S7"),
    ("san_lorenzo", "A1V1", ["A1"], "Recalado", "recepcion", "solidos", "S0 S2 S1 S3 S4 S5 S7"),
    ("san_lorenzo", "A1V2", ["A1"], "Espera en playa", "recepcion", "solidos", "S0 S1 S2 S4 S6 S7"),
    ("san_lorenzo", "A1V3", ["A1"], "Observaciones calidad", "recepcion", "solidos", "S0 S1 S3 S4 S5 S7"),
    ("san_lorenzo", "A1V4", ["A1"], "Observación descarga", "recepcion", "solidos", "S0 S1 S3 S4 S5 S7"),
    ("san_lorenzo", "B1V0", ["B1"], "Completo", "despacho", "solidos", None),
    ("san_lorenzo", "B1V1", ["B1"], "Error de peso", "despacho", "solidos", None),
    ("san_lorenzo", "B1V2", ["B1"], "Espera calado", "despacho", "solidos", None),
    ("san_lorenzo", "C1V0", ["C1"], "Punto 1", "recepcion", "liquidos", None),
    ("san_lorenzo", "C2V0", ["C2"], "Punto 2", "recepcion", "liquidos", None),
    ("san_lorenzo", "C3V0", ["C3"], "Renova", "recepcion", "liquidos", None),
    ("san_lorenzo", "D1V0", ["D1"], "Punto 1", "despacho", "liquidos", None),
    ("san_lorenzo", "D2V0", ["D2"], "Punto 2", "despacho", "liquidos", None),
    ("san_lorenzo", "D3V0", ["D3"], "Renova", "despacho", "liquidos", None),
]

OPERATIONS = [
    ("recepcion-solidos", "Recepción / Descargas"),
    ("recepcion-liquidos", "Recepción líquido"),
    ("despacho-solidos", "Despacho"),
    ("despacho-liquidos", "Despacho líquido"),
    ("movimiento_interno-transile", "Transile"),
]

PATHS_WITH_DISCHARGE = [
    "ABCDEF", "ABCCDEF", "ABCCCDEF", "AGBCDEF", "ABGCDEF", "ABCGDEF", "ABCGCDEF", "ABGCCDEF", "ABCGCGCDEF",
    "ABCDDEF", "AGBCDDEF", "ABGCDDEF", "ABCGDDEF", "ABCGCDDEF", "ABCGCGCDDEF",
]
PATHS_WITHOUT_DISCHARGE = ["ABCF", "AGBCF", "ABGCF", "ABCGF", "ABCGCF", "ABCGCGF"]

#: Radar references: metric, best, worst; and metric, least, most, whether more is better.
STAY_RADAR = [("moda", 4.0, 14.0), ("mediana", 4.0, 14.0), ("p90", 6.0, 18.0), ("iqr", 1.0, 8.0), ("std", 0.0, 6.0)]
SHAPE_RADAR = [("pico_frecuencia_pct", 0.5, 15.0, True), ("en_rango_central_pct", 40.0, 90.0, True), ("en_cola_derecha_pct", 0.0, 35.0, False)]

#: Names of sectors, and those that a site calls otherwise.
SECTOR_NAMES = {
    "S0": "Preingreso", "S1": "Ingreso", "S2": "Calada", "S3": "Tramo S3", "S4": "Balanza", "S5": "Descarga / tránsito", "S6": "Sector S6",
    "S7": "Sector S7", "S8": "Sector S8", "S9": "Sector S9", "S10": "Egreso",
}
SITE_SECTOR_NAMES = {
    "san_lorenzo": {
        "S3": "Enlace S1–S3", "S4": "Balanza / playa", "S5": "Descarga", "S6": "Tramo S3–S6", "S7": "Enlace S5–S7", "S8": "Enlace S8–S2", "S10": "Egreso final",
    },
    "ricardone": {
        "S0": "Ingreso a Planta", "S1": "Pre-ingreso", "S2": "Calada", "S3": "Salida 1", "S4": "Balanza", "S5": "Celda 16", "S6": "Punto de paso",
        "S7": "Puntos de carga/descarga", "S8": "Punto de carga", "S9": "Volcable 1 / Volcable 2", "S10": "Salida 2",
    },
}

#: Display names of gate events.
EVENT_LABELS = {
    "QUEUE_OUTSIDE": "Cola exterior", "GATE_CHECKIN": "Ingreso portería", "DOCS_OK": "Documentación OK", "DOCS_PROBLEM": "Problema documentación",
    "SCALE_IN": "Pesaje entrada", "YARD_WAIT": "Espera en patio", "SAMPLE_SOLID_TAKEN": "Calada (sólidos)", "SAMPLE_LIQUID_TAKEN": "Muestreo líquido",
    "LAB_RESULT_READY": "Resultado laboratorio", "DISCHARGE_ASSIGNED": "Descarga asignada", "DISCHARGE_START": "Inicio descarga", "DISCHARGE_END": "Fin descarga",
    "SCALE_OUT": "Pesaje salida", "EXIT": "Egreso", "UNKNOWN": "Desconocido",
}

#: Roles of the camera sectors that have one; critical sectors.
CAMERA_SECTORS = {"S0": "INGRESO", "S1": "EGRESO", "S2": "CALADA", "S4": "BALANZA"}

#: Fleet panels: group, label, operation type; and the operation type of a circuit's kind.
FLEET_PANELS = [("DESCARGA", "Descarga", "RECEPCION"), ("CARGA", "Carga", "DESPACHANDO"), ("TRANSILE", "Transile", "TRANSILE")]
OPERATION_TYPES = {"recepcion": "RECEPCION", "despacho": "DESPACHANDO", "movimiento_interno": "TRANSILE"}

#: The order in which products of anomalous trips are shown; others follow by name.
PRODUCT_ORDER = ["Maíz", "Soja", "Girasol", "Trigo"]

#: Steps of a visit in logical order, which decides between events of one instant.
STEP_ORDER = {
    "GATE_CHECKIN": 0, "SCALE_IN": 1, "SAMPLE_SOLID_TAKEN": 2, "SAMPLE_LIQUID_TAKEN": 2, "LAB_RESULT_READY": 3, "DISCHARGE_START": 4, "DISCHARGE_END": 5,
    "SCALE_OUT": 6, "EXIT": 7, "YARD_WAIT": 8,
}

# -------------------------------------------------------------------------------------------------------------------


def sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, n, i) for i, (s, n) in enumerate(SITES)], "site_id string, site_name string, site_ordinal int")


def capacity(spark: SparkSession, divisor: int = 1) -> DataFrame:
    """(site_id, sector, capacity); a divisor gives the scaled-down table, 1 at least."""
    rows = [(s, k, max(1, c // divisor)) for s, m in CAPACITY.items() for k, c in m.items()]
    return spark.createDataFrame(rows, "site_id string, sector string, capacity int")


def circuits(spark: SparkSession) -> DataFrame:
    rows, seen = [], {}
    for site, code, eq, name, kind, sub, seq in CIRCUITS:
        seen[site] = seen.get(site, -1) + 1
        rows.append((site, seen[site], code, eq, name, kind, sub, f"{kind}-{sub}", seq and seq.split(" ")))
    return spark.createDataFrame(
        rows, "site_id string, ordinal int, code string, equivalents array<string>, circuit_name string, kind string, subkind string, operation string, sequence array<string>"
    )


def operations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, i) for i, (k, n) in enumerate(OPERATIONS)], "operation string, operation_name string, operation_ordinal int")


def cameras(spark: SparkSession) -> DataFrame:
    """(camera_id, sector, camera_name, role, critical, site_id): eleven cameras at each site."""
    rows = [(f"CAM_S{i}_{i + 1:02d}", f"S{i}", f"Camara S{i}", CAMERA_SECTORS.get(f"S{i}", f"SECTOR_S{i}"), f"S{i}" in CAMERA_SECTORS, s) for s, _ in SITES for i in range(11)]
    return spark.createDataFrame(rows, "camera_id string, sector string, camera_name string, role string, critical boolean, site_id string")


def sector_names(spark: SparkSession) -> DataFrame:
    """(site_id, sector, sector_name): the site's own names before the common ones."""
    rows = [(s, k, SITE_SECTOR_NAMES.get(s, {}).get(k, name)) for s, _ in SITES for k, name in SECTOR_NAMES.items()]
    return spark.createDataFrame(rows, "site_id string, sector string, sector_name string")


def values_sql(rows: list[tuple], columns: str) -> str:
    """The rows as an SQL VALUES list with a column list, for engines that share no session with Spark."""

    def text(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(map(text, v)) + "]"
        return "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS t({columns})"
