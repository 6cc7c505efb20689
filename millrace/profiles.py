"""Field profiles: what the columns of a kind of table should be. Loaded from dicts or JSON, with inheritance."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from millrace.errors import InheritanceTooDeep, UnknownAsset

DEPTH = 3
TYPES = ("string", "float", "integer", "date", "boolean")


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    required: bool = False
    aliases: tuple[str, ...] = ()
    unit: str = ""
    min: float | None = None
    max: float | None = None
    enum: tuple[str, ...] = ()
    pattern: str = ""
    validator: str = ""
    access_level: str = "public"
    normalization: tuple[str, ...] = ()
    common_errors: tuple[str, ...] = ()
    default: Any = None

    @staticmethod
    def of(name: str, d: dict) -> Field:
        d = {"normalization" if k == "normalization_available" else k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
        return Field(name, **{k: v for k, v in d.items() if k in Field.__dataclass_fields__ and k != "name"})

    def repairs(self) -> set[str]:
        """The repairs that the free-text hints ask for."""
        hints = " ".join(self.common_errors)
        return {k for k, words in {"unit": ("万", "unit"), "negative": ("负", "negative"), "swapped": ("颠倒", "swapped")}.items() if any(w in hints for w in words)}


@dataclass(frozen=True)
class Profile:
    profile_id: str
    fields: dict[str, Field]
    computed: dict[str, str] = field(default_factory=dict)
    columns: tuple[str, ...] = ()
    lifecycle: dict[str, Any] = field(default_factory=dict)
    sensitivity: str = ""

    @staticmethod
    def of(d: dict) -> Profile:
        return Profile(d["profile_id"], {k: Field.of(k, v) for k, v in d.get("fields", {}).items()}, dict(d.get("computed", {})), tuple(d.get("columns", ())), dict(d.get("lifecycle", {})), d.get("sensitivity", ""))


def merge(child: dict, parent: dict) -> dict:
    """The child's definition over the parent's: fields attribute by attribute, other maps one level deep."""
    out = copy.deepcopy(parent)
    out["profile_id"] = child["profile_id"]
    for name, attributes in child.get("fields", {}).items():
        out.setdefault("fields", {}).setdefault(name, {}).update(attributes)
    for part in ("computed", "lifecycle"):
        out.setdefault(part, {}).update(child.get(part, {}))
    if child.get("columns"):
        out["columns"] = child["columns"]
    out.pop("inherits_from", None)
    return out


class Catalogue:
    """Profiles by id and by asset type."""

    def __init__(self, definitions: list[dict], assets: dict[str, str]):
        self.definitions = {d["profile_id"]: d for d in definitions}
        self.assets = dict(assets)

    @staticmethod
    def load(folder: str) -> Catalogue:
        """index.json ({"assets": {asset: profile_id}}) and every other JSON file below folder; bad files are skipped."""
        index, found = json.loads((Path(folder) / "index.json").read_text()), []
        for p in sorted(Path(folder).rglob("*.json")):
            try:
                d = json.loads(p.read_text())
            except ValueError:
                continue
            if isinstance(d, dict) and "profile_id" in d:
                found.append(d)
        return Catalogue(found, index["assets"])

    def resolve(self, profile_id: str, depth: int = 0) -> dict:
        if depth > DEPTH:
            raise InheritanceTooDeep(f"{profile_id}: more than {DEPTH} levels")
        d = self.definitions[profile_id]
        parent = d.get("inherits_from")
        if parent and parent in self.definitions:
            return merge(d, self.resolve(parent, depth + 1))
        return {k: v for k, v in d.items() if k != "inherits_from"}

    def get(self, asset: str) -> Profile:
        if asset not in self.assets:
            raise UnknownAsset(asset)
        return Profile.of(self.resolve(self.assets[asset]))


def _f(type_: str, *aliases: str, **more) -> dict:
    return {"type": type_, "aliases": list(aliases), **more}


DEFINITIONS = [
    {"profile_id": "REAL_ESTATE_BASE", "fields": {
        "property_address": _f("string", "房产地址", "address", required=True, access_level="restricted"),
        "building_area_sqm": _f("float", "建筑面积", "area", unit="㎡", min=0, max=100000, normalization_available=["zscore", "minmax"]),
        "land_area_sqm": _f("float", "土地面积", unit="㎡", min=0),
        "valuation_amount": _f("float", "评估价值", "valuation", unit="元", min=0, access_level="internal", normalization_available=["zscore"], common_errors=["negative"]),
    }},
    {"profile_id": "RE_MORTGAGE", "inherits_from": "REAL_ESTATE_BASE", "fields": {
        "mortgage_amount": _f("float", "抵押金额", "loan", unit="元", min=0, required=True, common_errors=["unit 万"]),
        "mortgage_ratio": _f("float", "抵押率", min=0, max=2, common_errors=["swapped"]),
        "mortgagee": _f("string", "抵押权人", access_level="internal"),
        "registration_date": _f("date", "登记日期"),
    }, "computed": {"loan_to_value": "mortgage_amount / valuation_amount if valuation_amount else null"}, "columns": ["property_address", "mortgage_amount", "valuation_amount"], "lifecycle": {"default_ttl_days": 365}},
    {"profile_id": "SHIP_BASE", "fields": {
        "ship_name": _f("string", "船名", required=True), "imo_number": _f("string", "IMO编号", validator="imo_validator"),
        "gross_tonnage": _f("float", "总吨位", unit="GT", min=0), "build_year": _f("integer", "建造年份", min=1900, max=2100),
        "valuation_amount": _f("float", "评估价值", unit="元", min=0, access_level="internal"),
    }},
    {"profile_id": "SHIP_NPL", "inherits_from": "SHIP_BASE", "fields": {
        "npl_amount": _f("float", "不良金额", unit="元", min=0, required=True), "npl_classification": _f("string", "五级分类", enum=["正常", "关注", "次级", "可疑", "损失"]),
        "creditor": _f("string", "债权人", access_level="internal"), "loan_start_date": _f("date", "起始日"), "loan_end_date": _f("date", "到期日"),
        "collateral_coverage_ratio": _f("float", "抵押覆盖率", min=0),
    }, "computed": {"npl_ratio": "npl_amount / valuation_amount if valuation_amount else null", "remaining_days": "loan_end_date - today() if loan_end_date else null"}},
    {"profile_id": "EQUIPMENT_BASE", "fields": {
        "equipment_name": _f("string", "设备名称", required=True), "purchase_price": _f("float", "购置价格", unit="元", min=0, required=True),
        "purchase_date": _f("date", "购置日期"), "useful_life_years": _f("integer", "使用年限", min=1, max=100), "residual_rate": _f("float", "残值率", min=0, max=1, default=0.05),
    }, "computed": {
        "annual_depreciation": "purchase_price * (1 - residual_rate) / useful_life_years if useful_life_years else null",
        "years_since_purchase": "(today() - purchase_date) / 365.25 if purchase_date else null",
        "current_value": "purchase_price - annual_depreciation * years_since_purchase if all([annual_depreciation, years_since_purchase]) else purchase_price",
    }},
    {"profile_id": "EQUIPMENT", "inherits_from": "EQUIPMENT_BASE", "fields": {
        "department": _f("string", "部门"), "location": _f("string", "位置"), "status": _f("string", "状态", enum=["在用", "闲置", "报废"]), "last_maintenance_date": _f("date", "维护日期"),
    }},
    {"profile_id": "CUSTOMER", "fields": {
        "c_custkey": _f("integer", required=True), "c_name": _f("string", "customer_name", required=True, access_level="restricted", pattern=r"Customer#\d+"),
        "c_nationkey": _f("integer", min=0, max=24), "c_acctbal": _f("float", "balance", min=0, max=9000, access_level="internal", common_errors=["negative"], normalization_available=["zscore", "minmax"]),
        "c_mktsegment": _f("string", "segment", enum=["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]),
    }, "computed": {"balance_per_nation": "c_acctbal / c_nationkey if c_nationkey else null"}},
    {"profile_id": "LINEITEM", "fields": {
        "l_orderkey": _f("integer", required=True), "l_quantity": _f("float", min=1, max=45), "l_extendedprice": _f("float", "price", min=0, normalization_available=["zscore", "minmax"]),
        "l_discount": _f("float", min=0, max=0.08), "l_tax": _f("float", min=0, max=1), "l_returnflag": _f("string", enum=["A", "N"]),
    }, "computed": {"net_price": "l_extendedprice * (1 - l_discount)", "gross_price": "net_price * (1 + l_tax)"}},
]
CATALOGUE = Catalogue(DEFINITIONS, {"real_estate_mortgage": "RE_MORTGAGE", "ship_npl": "SHIP_NPL", "equipment": "EQUIPMENT", "customer": "CUSTOMER", "lineitem": "LINEITEM"})
