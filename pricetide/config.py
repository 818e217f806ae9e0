"""Thresholds and fixed values. All thresholds are arguments with these defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

KEYS = ("population",)


@dataclass(frozen=True)
class Thresholds:
    """Numeric limits of the analysis, in the units of the price column."""

    # fixed values: the default limits
    search_band: tuple[float, float] = (400_000, 700_000)
    trend_band: tuple[float, float] = (150_000, 1_500_000)
    target_band: tuple[float, float] = (500_000, 600_000)
    renovation_band: tuple[float, float] = (400_000, 500_000)
    renovation_budget: float = 100_000
    hard_max_price: float = 620_000
    max_reasonable_price: float = 1e8
    bridge_days: int = 5
    relist_lookback_days: int = 90
    relist_price_tol: float = 0.03
    relist_sqm_tol: int = 3
    cluster_price_tol: float = 0.015
    cluster_sqm_tol: int = 3
    title_similarity: float = 0.45
    grace_runs: int = 2
    train_price: tuple[float, float] = (150_000, 2_000_000)
    train_sqm: tuple[float, float] = (30, 800)
    quality_sqm: tuple[float, float] = (35, 400)
    offer_step: float = 5_000
    max_margin: float = 18.0
    # fixed value: sources that are portals, every other source counts as an agency
    portals: tuple[str, ...] = ("idealista_local", "yaencontre", "idealista")


@dataclass(frozen=True)
class BuyerProfile:
    """Budget of one buyer. The default budget."""

    monthly_net_income: float = 6_500.0
    savings: float = 160_000.0
    extra_cash_if_needed: float = 30_000.0
    monthly_savings: float = 3_300.0
    annual_rate_pct: float = 2.0
    term_years: int = 30
    comfortable_payment: float = 1_500.0
    max_payment: float = 1_700.0
    stretch_payment: float = 1_800.0
    itp_rate: float = 0.10
    fees_rate: float = 0.015
    max_ltv: float = 0.80


@dataclass(frozen=True)
class IdealProfile:
    """A favourite entity the similarity score compares against."""

    name: str
    property_type: str | None = None
    city: str | None = None
    district: str | None = None
    neighborhood: str | None = None
    postal_code: str | None = None
    target_price: float | None = None
    price_tolerance_pct: float = 0.25
    target_rooms: float | None = None
    rooms_tolerance: int = 1
    target_bathrooms: float | None = None
    bathrooms_tolerance: int = 1
    target_sqm: float | None = None
    sqm_tolerance_pct: float = 0.25
    required_location_terms: tuple[str, ...] = ()
    preferred_terms: tuple[str, ...] | None = ()
    preferred_features: dict[str, bool] = field(default_factory=dict)
    preferred_sources: tuple[str, ...] = ()
    latitude: float | None = None
    longitude: float | None = None
    max_distance_km: float = 5.0


@dataclass(frozen=True)
class TenantRules:
    """Per-tenant cleaning rules."""

    city_pattern: str
    exclude_title_pattern: str | None = None
    neighborhoods: tuple[str, ...] = ()
    zones: tuple[str, ...] = ()


# --- fixed values: favourite profiles and alert terms ---
FAVOURITE_PROFILES = (
    IdealProfile(
        name="Casa familiar Sant Cugat",
        property_type="house",
        city="Sant Cugat del Vallès",
        district="Valldoreix",
        target_price=650_000,
        target_rooms=4,
        target_bathrooms=2,
        target_sqm=140,
        required_location_terms=("sant cugat", "valldoreix", "mirasol", "mira-sol"),
        preferred_terms=("casa", "adosada", "unifamiliar"),
        preferred_features={"has_pool": True, "has_ac": True},
        preferred_sources=("idealista", "local"),
        max_distance_km=5,
    ),
    IdealProfile(
        name="Piso amplio Cerdanyola",
        property_type="flat",
        city="Cerdanyola del Vallès",
        district="Bellaterra",
        target_price=450_000,
        price_tolerance_pct=0.20,
        target_rooms=3,
        target_bathrooms=2,
        target_sqm=100,
        sqm_tolerance_pct=0.20,
        required_location_terms=("cerdanyola", "bellaterra", "serra parera"),
        preferred_terms=("piso", "ático", "duplex"),
        preferred_features={"has_ac": True},
        preferred_sources=("idealista", "local"),
        max_distance_km=6,
    ),
)
MIN_SIMILARITY = 65
ALERT_LOCATION_TERMS = ("sant cugat", "cerdanyola", "valldoreix", "mirasol", "bellaterra", "serra parera")
SIMILARITY_WEIGHTS = {
    "price": 22, "rooms": 10, "bathrooms": 10, "sqm": 14, "property_type": 8,
    "location": 20, "features": 8, "terms": 5, "source": 3,
}

# --- fixed values: patterns of titles and texts ---
NON_RESIDENTIAL = (
    r"^\s*(locales?\s+comerciales?|nau(\s+industrial)?|traster(o|os)\b|"
    r"plaza(s)?\s+de\s+(garaje|parking)|garaje(s)?\b)"
)
MUNICIPALITIES = (
    "Barcelona", "Viladecavalls", "Santa Coloma de Gramenet", "Hostafrancs", "Horta", "Camp de l'Arpa", "Rubí",
    "Rubi", "Terrassa", "Sabadell", "Badalona", "Montcada", "Ripollet", "Barberà", "Barbera",
    "Castellar del Vallès", "Sentmenat", "Hospitalet", "Molins de Rei", "El Papiol", "Castellbisbal",
    "Sant Cugat", "Sant Quirze", "Cerdanyola",
)

# --- fixed values: text patterns, matched on folded lower-case text ---
SELLER_PATTERNS = {
    "inheritance": r"herencia|her[eè]ncia",
    "urgency": r"\burge\b|urgente|urgent\b|traslado|trasllat",
    "negotiable": r"negociabl|escucha ofertas|escoltem ofertes|precio a convenir",
    "opportunity": r"oportunidad|oportunitat|ocasi[oó]n|chollo|rebajad|rebaixat",
    "renovation": r"a reformar|para reformar|per reformar|reforma integral|para actualizar|per actualitzar|origen\b",
    "investor": r"inversor|inversores|inversi[oó]n|rentabilidad",
    "divorce_or_sale_urgency": r"divorcio|divorci|liquidaci[oó]n",
}
HOME_PATTERNS = {
    "luminous": r"luminos[ao]|molta llum|mucha luz|gran luminosidad",
    "views": r"vistas? (a|al|a la)|vistes a|con vistas|amb vistes",
    "renovated": (
        r"reformad[ao] integralmente|a estrenar|reci[eé]n reformad[ao]|reforma integral|obra nueva|acabat de reformar"
    ),
    "garden": r"jard[ií]n privad|jard[íi] privat|jard[ií]n comunitario",
    "storage": r"trastero|traster\b",
    "quiet": r"tranquil[oa]|silencios[ao]|sense soroll|sin ruido|zona tranquila",
    "exterior": r"\bexterior\b",
}
TRANSIT_PATTERN = r"\bfgc\b|estaci[oó]n (de )?(tren|fgc|renfe)|\brenfe\b|cerca del?\s*tren"
ORIENTATION_PATTERN = (
    r"(?i)orientaci\w*.{0,25}?\b(noreste|nordest|noroeste|nordoest|sureste|sudest|suroeste|sudoest|"
    r"nord|norte|sud|sur|est\b|este\b|oest\b|oeste\b)"
)
ORIENTATION_NAMES = {
    "nord": "norte", "norte": "norte", "sud": "sur", "sur": "sur", "est": "este", "este": "este",
    "oest": "oeste", "oeste": "oeste", "nordest": "noreste", "noreste": "noreste", "nordoest": "noroeste",
    "noroeste": "noroeste", "sudest": "sureste", "sureste": "sureste", "sudoest": "suroeste",
    "suroeste": "suroeste",
}
WALK_PATTERN = r"(?i)(\d{1,2})\s*min\w*.{0,20}?(estaci[oó]n|fgc|tren|renfe)"
STREET_PATTERN = (
    r"(?iu)(?U)\b((?:calle|avenida|avinguda|passeig|paseo|carrer|ronda|pla[cç]a|plaza|carretera)\s+[^,]+)"
)
FEE_PATTERN = r"(?iu)comunidad[:\s]*([\d][\d.,]*)\s*€"
PROPERTY_TAX_PATTERN = r"(?iu)(?U)\bibi[:\s]*([\d][\d.,]*)\s*€"
TITLE_TYPES = {
    "atico": r"\b(?:atico|atic)\b",
    "planta_baja": r"\bplanta bai?xa\b|\bbaixos\b",
    "duplex": r"\bduplex\b",
    "estudio": r"\b(?:estudio|estudi|loft)\b",
    "casa": r"\b(?:casa|chalet|xalet|torre|masia|adosad\w+|adossad\w+|pareado|aparellad\w+)\b",
    "piso": r"\b(?:piso|pis|apartamento|apartament)\b",
}
# each of these may name the same unit as "piso"
PISO_ALIASES = ("planta_baja", "duplex", "estudio")
STREET_WORDS = (
    r"calle|carrer|avenida|avinguda|paseo|passeig|ronda|rambla|plaza|placa|pasaje|passatge|camino|cami"
)
STREET_STOP_WORDS = ("de", "del", "d", "la", "el", "les", "los", "las", "dels", "en")
BOILERPLATE_PATTERN = (
    r"(?iu)(?U)reglamento \(ue\)|\brgpd\b|\bgdpr\b|pol[ií]tica de (privacidad|cookies)|"
    r"aviso legal|protecci[oó]n de datos|utilizamos cookies|esta web utiliza cookies"
)

# --- fixed values: the columns a details patch may change ---
PATCHABLE = (
    "description", "agent", "floor", "terrace", "elevator", "parking", "year_built", "energy_rating",
    "orientation", "neighborhood", "postal_code", "latitude", "longitude", "property_type", "sqm",
)
REQUIRED_FIELDS = ("property_id", "source", "title", "url", "price", "rooms", "bathrooms", "sqm")
OPTIONAL_FIELDS = (
    "property_type", "operation", "city", "district", "neighborhood", "postal_code", "latitude", "longitude",
    "energy_rating", "year_built", "floor", "terrace", "elevator", "parking",
)
