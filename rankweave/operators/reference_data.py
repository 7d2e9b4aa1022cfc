"""Fixed tables: industries to super-groups, countries to currencies; and the joins that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Super-groups and their industries.
SUPER_GROUPS = {
    "software-internet": ["Software - Application", "Software - Infrastructure", "Internet Content & Information", "Information Technology Services"],
    "semis-hardware": ["Semiconductors", "Semiconductor Equipment & Materials", "Computer Hardware", "Communication Equipment", "Electronic Components", "Scientific & Technical Instruments"],
    "pharma-biotech": ["Drug Manufacturers - General", "Drug Manufacturers - Specialty & Generic", "Biotechnology"],
    "healthcare-equipment": ["Medical Devices", "Medical Instruments & Supplies", "Diagnostics & Research"],
    "healthcare-services": ["Healthcare Plans", "Medical Distribution", "Medical Care Facilities"],
    "banks-lending": ["Banks - Regional", "Banks - Diversified", "Credit Services"],
    "capital-markets": ["Asset Management", "Capital Markets", "Financial Data & Stock Exchanges"],
    "insurance": ["Insurance - Property & Casualty", "Insurance Brokers", "Insurance - Life", "Insurance - Diversified", "Insurance - Reinsurance"],
    "reits-real-estate": ["REIT - Specialty", "REIT - Residential", "REIT - Retail", "REIT - Industrial", "REIT - Healthcare Facilities", "REIT - Office", "REIT - Hotel & Motel", "REIT - Diversified", "Real Estate Services"],
    "utilities": ["Utilities - Regulated Electric", "Utilities - Independent Power Producers", "Utilities - Diversified", "Utilities - Regulated Gas", "Utilities - Regulated Water"],
    "energy": ["Oil & Gas E&P", "Oil & Gas Integrated", "Oil & Gas Refining & Marketing", "Oil & Gas Equipment & Services", "Oil & Gas Midstream"],
    "industrials": [
        "Specialty Industrial Machinery", "Aerospace & Defense", "Farm & Heavy Construction Machinery", "Electrical Equipment & Parts", "Tools & Accessories", "Industrial Distribution", "Conglomerates",
        "Waste Management", "Specialty Business Services", "Consulting Services", "Pollution & Treatment Controls", "Rental & Leasing Services", "Security & Protection Services",
    ],
    "materials-construction": [
        "Specialty Chemicals", "Chemicals", "Agricultural Inputs", "Steel", "Copper", "Gold", "Packaging & Containers", "Building Products & Equipment", "Engineering & Construction", "Building Materials",
        "Residential Construction", "Solar",
    ],
    "transport-autos": ["Integrated Freight & Logistics", "Railroads", "Airlines", "Trucking", "Auto Manufacturers", "Auto Parts"],
    "consumer-staples": [
        "Packaged Foods", "Household & Personal Products", "Beverages - Non-Alcoholic", "Beverages - Brewers", "Beverages - Wineries & Distilleries", "Tobacco", "Confectioners", "Farm Products",
        "Discount Stores", "Grocery Stores", "Food Distribution",
    ],
    "consumer-discretionary": [
        "Specialty Retail", "Internet Retail", "Apparel Retail", "Home Improvement Retail", "Auto & Truck Dealerships", "Luxury Goods", "Apparel Manufacturing", "Footwear & Accessories",
        "Consumer Electronics", "Restaurants", "Travel Services", "Resorts & Casinos", "Lodging", "Leisure", "Electronic Gaming & Multimedia", "Personal Services",
    ],
    "media-telecom": ["Entertainment", "Telecom Services", "Advertising Agencies"],
}

#: Currencies in which companies of a country report.
CURRENCIES = {
    "USD": ["United States", "USA", "Bermuda", "Cayman Islands"], "DKK": ["Denmark"], "SEK": ["Sweden"], "NOK": ["Norway"], "CHF": ["Switzerland"], "GBP": ["United Kingdom"],
    "EUR": ["Ireland", "Germany", "France", "Netherlands", "Spain", "Italy", "Belgium", "Austria", "Portugal", "Finland", "Luxembourg"],
    "CAD": ["Canada"], "BRL": ["Brazil"], "MXN": ["Mexico"], "ARS": ["Argentina"], "CLP": ["Chile"],
    "JPY": ["Japan"], "CNY": ["China"], "HKD": ["Hong Kong"], "TWD": ["Taiwan"], "SGD": ["Singapore"], "KRW": ["South Korea", "Korea"], "INR": ["India"], "IDR": ["Indonesia"], "THB": ["Thailand"],
    "MYR": ["Malaysia"], "PHP": ["Philippines"], "VND": ["Vietnam"], "ILS": ["Israel"], "TRY": ["Turkey"], "SAR": ["Saudi Arabia"], "AED": ["United Arab Emirates"], "AUD": ["Australia"], "NZD": ["New Zealand"], "ZAR": ["South Africa"],
}


def _told_by(table: dict[str, list[str]], name: Column) -> Column:
    """The key whose list holds name, else null: a map literal, looked up inside the row."""
    pairs = [F.lit(x) for key, names in table.items() for n in names for x in (n, key)]
    return F.try_element_at(F.create_map(*pairs), name)


def super_group(industry: Column) -> Column:
    return F.when(industry.isNotNull(), _told_by(SUPER_GROUPS, industry))


def reporting_currency(stated: Column, country: Column) -> Column:
    """The stated currency, else that of the country, else USD."""
    return F.coalesce(stated, F.when(country.isNotNull(), _told_by(CURRENCIES, country)), F.lit("USD"))


def with_fx(rows: DataFrame, fx: DataFrame) -> DataFrame:
    """rows (reporting_currency, quote_currency) with fx_rate, 1 where they agree or no rate is known, and fx_missing for the latter.

    fx: source, target, rate, one row a pair of currencies.
    """
    pairs = fx.select(F.col("source").alias("reporting_currency"), F.col("target").alias("quote_currency"), F.col("rate").alias("_rate"))
    out = rows.join(pairs, ["reporting_currency", "quote_currency"], "left")
    differ = F.col("reporting_currency") != F.col("quote_currency")
    return out.withColumns({"fx_rate": F.when(differ, F.coalesce("_rate", F.lit(1.0))).otherwise(1.0), "fx_missing": differ & F.col("_rate").isNull()}).drop("_rate")


def provider_ttm(rows: DataFrame, tax: float = 0.21) -> DataFrame:
    """rows with trailing metrics from provider fields; those in the statements' currency are turned by fx_rate.

    rows: price, market_cap, enterprise_value, trailing_pe, trailing_eps (quote currency), ebitda,
    total_debt, total_cash, free_cash_flow (statement currency), fx_rate, and equity and ebit of the
    newest year as they were stored.
    """
    c = F.col
    fx = lambda x: c(x) * c("fx_rate")
    debt, cash, ebitda, fcf = fx("total_debt"), fx("total_cash"), fx("ebitda"), fx("free_cash_flow")
    pe = F.when(c("trailing_pe") > 0, c("trailing_pe")).when(c("trailing_eps") > 0, c("price") / c("trailing_eps"))
    invested = c("equity") + debt - F.coalesce(cash, F.lit(0.0))
    return rows.withColumns({
        "pe_ratio": pe, "price_to_fcf": F.when((fcf > 0) & (c("market_cap") > 0), c("market_cap") / fcf), "net_debt_to_ebitda": F.when(ebitda > 0, (debt - cash) / ebitda),
        "invested_capital": invested, "roic": F.when(invested > 0, c("ebit") * (1 - tax) / invested), "earnings_yield": F.when(pe > 0, 1 / pe), "fcf_yield": F.when(c("market_cap") > 0, fcf / c("market_cap")),
    })


def annual_dividend(dividend_yield: Column, price: Column) -> Column:
    return F.coalesce(dividend_yield, F.lit(0.0)) * price


def negative_equity(equity: Column) -> Column:
    return F.coalesce(equity < 0, F.lit(False))


def authoritative_shares(market_cap: Column, price: Column, annual_shares: Column) -> Column:
    """Market value over price, else the shares of the newest year, else 0."""
    return F.coalesce(F.when((price > 0) & (market_cap > 0), market_cap / price), annual_shares, F.lit(0.0))


def range_of_year(provider_high: Column, provider_low: Column, closes_high: Column, closes_low: Column) -> tuple[Column, Column]:
    """High and low of the year: the provider's, else those of the closes, else 0."""
    return F.coalesce(provider_high, closes_high, F.lit(0.0)), F.coalesce(provider_low, closes_low, F.lit(0.0))
