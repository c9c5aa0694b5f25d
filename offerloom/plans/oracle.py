"""SQL that states the expected result of each registered query on the same tables."""

from __future__ import annotations

DEMOGRAPHICS = ["age_range", "marital_status", "rented", "family_size", "no_of_children", "income_bracket"]
AMOUNTS = ["selling_price", "other_discount", "coupon_discount"]

# The campaign tables, written as views over the order and line-item tables.
VIEWS = {
    "fx_impression": """
        select customer_id*10000000000 + coupon_id*100 + campaign_id as id, campaign_id, coupon_id, customer_id,
          case when campaign_id <= 18
               then max(case when l_returnflag = 'R' and l_quantity <= 2 then 1 else 0 end) end as redemption_status,
          case when campaign_id <= 18 then 'train' else 'test' end as source
        from (select cast((year(o_orderdate)-1995)*4 + quarter(o_orderdate) as int) as campaign_id,
                l_suppkey as coupon_id, o_custkey as customer_id, l_returnflag, l_quantity
              from lineitem join orders on l_orderkey = o_orderkey) t
        group by campaign_id, coupon_id, customer_id""",
    "fx_campaign": """
        select campaign_id, case when campaign_id % 5 = 0 then 'X' else 'Y' end as campaign_type,
          min(d) as start_date, max(d) as end_date
        from (select cast((year(o_orderdate)-1995)*4 + quarter(o_orderdate) as int) as campaign_id,
                cast(o_orderdate as date) as d from orders) t
        group by campaign_id""",
    "fx_coupon_item": "select distinct l_suppkey as coupon_id, l_partkey as item_id from lineitem",
    "fx_item": """
        select p_partkey as item_id, p_brand as brand,
          case when p_size % 5 = 0 then 'Local' else 'Established' end as brand_type, p_type as category
        from part""",
    "fx_demo": """
        select c_custkey as customer_id,
          case c_nationkey % 6 when 0 then '18-25' when 1 then '26-35' when 2 then '36-45' when 3 then '46-55'
            when 4 then '56-70' else '70+' end as age_range,
          case when c_mktsegment in ('BUILDING','FURNITURE') then 'Married'
               when c_mktsegment = 'MACHINERY' then 'Single' end as marital_status,
          c_nationkey % 2 as rented,
          case when c_nationkey % 5 = 4 then '5+' else cast(c_nationkey % 5 + 1 as varchar) end as family_size,
          case when c_nationkey % 4 = 0 then null when c_nationkey % 4 = 3 then '3+'
               else cast(c_nationkey % 4 as varchar) end as no_of_children,
          c_nationkey % 12 + 1 as income_bracket
        from customer where c_custkey % 2 = 0""",
    "fx_trans": """
        select cast(o_orderdate as date) as date, o_custkey as customer_id, l_partkey as item_id,
          l_quantity as quantity, l_extendedprice as selling_price,
          0.0 - l_extendedprice*l_discount as other_discount, 0.0 - l_extendedprice*l_tax as coupon_discount
        from lineitem join orders on l_orderkey = o_orderkey""",
}


def _mode(table: str, key: str, column: str) -> str:
    return f"""
        select {key}, {column} from (
          select {key}, {column}, row_number() over (partition by {key} order by n desc, {column}) as place
          from (select {key}, {column}, count(*) as n from {table} where {column} is not null group by {key}, {column})
        ) where place = 1"""


def _modes(table: str, key: str, columns: list[str]) -> str:
    joins = " ".join(f"left join ({_mode(table, key, c)}) m_{c} using ({key})" for c in columns)
    picked = ", ".join(f"m_{c}.{c}" for c in columns)
    return f"select k.{key}, {picked} from (select distinct {key} from {table}) k {joins}"


def _mean(column: str) -> str:
    """Mean of the amounts as they are: every digit of their shortest decimal form is added up."""
    return f"cast(sum(cast(cast({column} as varchar) as decimal(38,18))) as double) / count({column}) as {column}"


def _last(column: str, order: str) -> str:
    frame = "rows between unbounded preceding and current row"
    return f"last_value({column} ignore nulls) over (order by {order} {frame})"


def _filled(table: str) -> str:
    others = ", ".join(f"{_last(c, 'customer_id')} as {c}" for c in DEMOGRAPHICS if c != "no_of_children")
    children = f"coalesce({_last('no_of_children', 'customer_id')}, '0') as no_of_children"
    spend = f"customer_id, date, item_id, quantity, {', '.join(AMOUNTS)}"
    return f"select {spend}, {others}, {children} from {table}"


IMPUTED = """
        select customer_id, age_range, coalesce(marital_status, 'Unknown') as marital_status, rented,
          case when family_size = '5+' then '5' else family_size end as family_size,
          case when no_of_children is null then '0' when no_of_children = '3+' then '3'
               else no_of_children end as no_of_children,
          income_bracket
        from fx_demo"""


def _star(customers: str) -> str:
    people = ", ".join(DEMOGRAPHICS)
    return f"""
        select i.id, i.campaign_id, i.coupon_id, i.customer_id, i.redemption_status, i.source,
          c.campaign_type, c.start_date, c.end_date,
          p.item_id as item_id_x, p.brand, p.brand_type, p.category,
          u.date as trans_date, u.item_id as item_id_y, u.quantity, {', '.join(AMOUNTS)}, {people}
        from fx_impression i left join fx_campaign c using (campaign_id)
          left join coupons p using (coupon_id) left join {customers} u using (customer_id)"""


VIEWS |= {
    "coupon_items": """
        select coupon_id, item_id, brand, brand_type, category
        from fx_coupon_item left join fx_item using (item_id)""",
    "coupons": _modes("coupon_items", "coupon_id", ["item_id", "brand", "brand_type", "category"]),
    "spend": f"""
        select * from ({_modes("fx_trans", "customer_id", ["date", "item_id", "quantity"])})
        join (select customer_id, {', '.join(map(_mean, AMOUNTS))} from fx_trans group by customer_id)
        using (customer_id)""",
    "people_nofill": "select * from spend left join fx_demo using (customer_id)",
    "people_ffill": _filled("people_nofill"),
    "star": _star("people_ffill"),
    "star_nofill": _star("people_nofill"),
    "star_clean": """
        select * replace (case when no_of_children = '3+' then '3' else no_of_children end as no_of_children)
        from star""",
    "usual_date": _mode("fx_trans", "customer_id", "date"),
    "impression_dates": """
        select id, start_date, end_date, date as trans_date
        from fx_impression left join fx_campaign using (campaign_id) left join usual_date using (customer_id)""",
    "fx_train": "select * exclude (source) from fx_impression where source = 'train'",
    "fx_test": "select * exclude (source, redemption_status) from fx_impression where source = 'test'",
}


def _sql(body: str) -> str:
    """Put the views a statement needs, and what those need, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        words = set("".join(ch if ch.isalnum() or ch == "_" else " " for ch in text).split())
        for name in VIEWS:
            if name in words and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    views = ", ".join(f"{name} as materialized ({VIEWS[name]})" for name in needed)
    return f"with {views} {body}" if needed else body


def _hash(purpose: str, key: str = "cast(id as varchar)") -> str:
    return f"cast('0x' || substr(md5('26:{purpose}:' || {key}), 1, 8) as bigint)"


def _uniform(purpose: str, key: str = "cast(id as varchar)") -> str:
    return f"{_hash(purpose, key)} / cast(4294967296 as double)"


def _open(*columns: str) -> str:
    return ", ".join(f"cast({c} as double) as {c}" for c in columns)


def _union(parts: list[str]) -> str:
    return " union all ".join(parts)


def _code(column: str) -> str:
    return f"case when {column} is not null then dense_rank() over (order by {column} nulls last) - 1 end"


def _is(column: str, level: str | int, name: str) -> str:
    value = f"'{level}'" if isinstance(level, str) else level
    return f"coalesce(cast({column} = {value} as int), 0) as {name}"


CODES = {
    "category": ("category_code", "categ_code"),
    "age_range": ("age_range_code", "age_range_code"),
    "family_size": ("family_size_code", "family_code"),
    "no_of_children": ("no_of_children_code", "no_child_code"),
    "income_bracket": ("income_bracket_code", "income_code"),
}
# Highest code of each family on the check data; the lowest has no dummy.
HIGHEST_CODE = {
    "category_code": 5,
    "age_range_code": 5,
    "family_size_code": 4,
    "no_of_children_code": 2,
    "income_bracket_code": 11,
}


def _feature_table() -> str:
    codes = ", ".join(f"{_code(c)} as {code}" for c, (code, _) in CODES.items())
    dropped = ", ".join([*CODES, "campaign_type", "brand_type", "marital_status", "rented", *AMOUNTS])
    coded = f"""
        select * exclude ({dropped}, start_date, end_date, trans_date), {codes},
          {_is('campaign_type', 'X', 'campaign_x')}, {_is('campaign_type', 'Y', 'campaign_y')},
          {_is('brand_type', 'Established', 'brand_type_est')},
          {_is('marital_status', 'Married', '"Married"')}, {_is('marital_status', 'Single', '"Single"')},
          {_is('rented', 1, 'rented_1')},
          abs(date_diff('day', start_date, end_date)) as campaign_duration,
          abs(date_diff('day', start_date, trans_date)) as trans_duration,
          round(ln(1 + selling_price), 6) as selling_price_log,
          round(ln(1 + other_discount * other_discount), 6) as other_discount_log,
          round(ln(1 + coupon_discount * coupon_discount), 6) as coupon_discount_log
        from star_clean"""
    dummies = ", ".join(
        _is(code, level, f"{prefix}_{level}")
        for code, prefix in CODES.values()
        for level in range(1, HIGHEST_CODE[code] + 1)
    )
    return f"select * replace ({_open('redemption_status')}), {dummies} from ({coded})"


def _histogram(name: str, table: str, value: str, bins: int) -> str:
    return f"""
        select '{name}' as column_name, bin, round(lo + (hi - lo) / {bins} * bin, 6) as bin_from,
          (select count(*) from (select {value} as v from {table})
           where least(cast(floor((v - lo) / ((hi - lo) / {bins})) as int), {bins - 1}) = bin) as n
        from (select min({value}) as lo, max({value}) as hi from {table}), (select unnest(range({bins})) as bin)"""


def _describe(column: str) -> str:
    quartile = ", ".join(f"round(quantile_cont(v, {p}), 8) as q{int(100 * p)}" for p in (0.25, 0.5, 0.75))
    return f"""
        select '{column}' as column_name, count(v) as n, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std,
          round(min(v), 8) as min, {quartile}, round(max(v), 8) as max
        from (select cast({column} as double) as v from fx_trans)"""


def _quantile(column: str) -> str:
    tenths = ", ".join(f"round(quantile_cont(cast({column} as double), {p}), 8) as q{int(100 * p)}" for p in (0.1, 0.9))
    return f"select '{column}' as column_name, {tenths} from fx_trans"


def _correlations(table: str, columns: list[str]) -> list[str]:
    return [
        f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 6) as corr from {table}"
        for a in columns
        for b in columns
    ]


TYPES = {
    "fx_train": dict(id="bigint", campaign_id="int", coupon_id="bigint", customer_id="bigint", redemption_status="int"),
    "fx_test": dict(id="bigint", campaign_id="int", coupon_id="bigint", customer_id="bigint"),
    "fx_campaign": dict(campaign_id="int", campaign_type="string", start_date="date", end_date="date"),
    "fx_coupon_item": dict(coupon_id="bigint", item_id="bigint"),
    "fx_item": dict(item_id="bigint", brand="string", brand_type="string", category="string"),
    "fx_demo": dict(
        customer_id="bigint", age_range="string", marital_status="string", rented="int", family_size="string",
        no_of_children="string", income_bracket="int",
    ),
    "fx_trans": dict(
        date="date", customer_id="bigint", item_id="bigint", quantity="double", selling_price="double",
        other_discount="double", coupon_discount="double",
    ),
}
REPORT_NAME = {
    "fx_train": "train",
    "fx_test": "test",
    "fx_campaign": "campaign",
    "fx_coupon_item": "coupon_item",
    "fx_item": "item",
    "fx_demo": "demographics",
    "fx_trans": "transactions",
}


def _table_label(view: str) -> str:
    return REPORT_NAME.get(view, view)


NUNIQUE = {
    "fx_train": ["id", "campaign_id", "coupon_id", "customer_id"],
    "fx_test": ["id", "campaign_id", "coupon_id", "customer_id"],
    "fx_campaign": ["campaign_id", "campaign_type"],
    "fx_coupon_item": ["coupon_id", "item_id"],
    "fx_item": ["item_id", "brand", "brand_type", "category"],
    "fx_demo": ["customer_id"],
    "fx_trans": ["customer_id"],
}
KEYS = ["id", "coupon_id", "customer_id"]
STRINGS = [
    "source", "campaign_type", "brand", "brand_type", "category", "age_range", "marital_status", "family_size",
    "no_of_children",
]
DUMMY_LEVELS = {
    "rented": ("rented", [1]),
    "age_range": ("age", ["26-35", "36-45", "46-55", "56-70", "70+"]),
    "no_of_children": ("children", ["1", "2", "3"]),
    "income_bracket": ("income", list(range(2, 13))),
}


def _level_counts(table: str, columns: list[str]) -> list[str]:
    return [
        f"select '{c}' as column_name, cast({c} as varchar) as level, count(*) as n from {table} "
        f"where {c} is not null group by {c}"
        for c in columns
    ]


def _skewness(name: str, value: str) -> str:
    return f"select '{name}' as column_name, round(skewness({value}), 6) as skewness from fx_trans"


def _statements() -> dict[str, str]:
    keys = "id, campaign_id, coupon_id, customer_id"
    train_row = f"{keys}, redemption_status"
    impression = f"{keys}, cast(redemption_status as double) as redemption_status"
    gaps = ["redemption_status", "rented", "income_bracket"]
    ntile = f"ntile(10) over (order by {_hash('fold')}, id) - 1"
    per_label = f"row_number() over (partition by redemption_status order by {_hash('fold')}, id) - 1"
    one_hot = [
        ("campaign_type", "X"), ("campaign_type", "Y"), ("brand_type", "Established"),
        ("marital_status", "Married"), ("marital_status", "Single"),
    ]
    return {
        "q_scan_impressions": f"select {impression}, source from fx_impression",
        "q_stage_roundtrip": f"select {impression}, source from fx_impression",
        "q_union_train_test": f"""
            select {impression}, 'train' as source from fx_train
            union all select id, campaign_id, coupon_id, customer_id, null, 'test' from fx_test""",
        "q_split_source_train": f"select {train_row} from fx_train",
        "q_split_source_test": "select id, campaign_id, coupon_id, customer_id from fx_test",
        "q_string_columns": _union(
            [f"select '{c}' as column_name, count({c}) as n_filled, count(distinct {c}) as n_unique from star" for c in STRINGS]
        ),
        "q_missing_children_by_family": """
            select family_size, count(*) as n from fx_demo where no_of_children is null group by family_size""",
        "q_unknown_marital_with_children": f"""
            select customer_id, d.family_size, i.no_of_children from fx_demo d join ({IMPUTED}) i using (customer_id)
            where d.marital_status is null and i.no_of_children >= '1'""",
        "q_negative_campaign": """
            select o_custkey as customer_id, l_suppkey as coupon_id, cast(o_orderdate as date) as start_date,
              cast(l_shipdate as date) as end_date,
              date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as days
            from lineitem join orders on l_orderkey = o_orderkey
            where cast(l_shipdate as date) < cast(o_orderdate as date)""",
        "q_trans_before_start": """
            select id, start_date, trans_date, trans_date < start_date as before_start from impression_dates""",
        "q_join_campaign": f"""
            select {impression}, source, campaign_type, start_date, end_date
            from fx_impression left join fx_campaign using (campaign_id)""",
        "q_join_coupon_item": "select * from coupon_items",
        "q_mode_coupon_profile": "select * from coupons",
        "q_join_coupon_profile": f"""
            select {impression}, source, item_id, brand, brand_type, category
            from fx_impression left join coupons using (coupon_id)""",
        "q_mode_customer_all": _modes("fx_trans", "customer_id", ["date", "item_id", "quantity", *AMOUNTS]),
        "q_mode_two_stage": _mode("fx_trans", "customer_id", "item_id"),
        "q_customer_profile": "select * from spend",
        "q_customer_nofill": f"select * replace ({_open(*gaps[1:])}) from people_nofill",
        "q_customer_ffill": "select * from people_ffill",
        "q_customer_unknown": _filled(f"(select * from spend left join ({IMPUTED}) using (customer_id))"),
        "q_ffill_scalable": f"""
            select o_orderkey, {_last('p', 'o_orderkey')} as o_totalprice, {_last('r', 'o_orderkey')} as o_orderpriority
            from (select o_orderkey, case when o_orderstatus = 'F' then o_totalprice end as p,
                    case when o_orderstatus = 'F' then o_orderpriority end as r from orders)""",
        "q_star_join": f"select * replace ({_open(*gaps)}) from star",
        "q_star_join_nofill": f"select * replace ({_open(*gaps)}) from star_nofill",
        "q_row_counts": _union(
            [
                f"select '{_table_label(t)}' as table_name, count(*) as n_rows, {len(c)} as n_columns from {t}"
                for t, c in TYPES.items()
            ]
        ),
        "q_null_profile": _union(
            [
                f"select '{_table_label(t)}' as table_name, '{c}' as column_name, '{kind}' as data_type, "
                f"count(*) - count({c}) as n_null, count({c}) as n_non_null from {t}"
                for t, columns in TYPES.items()
                for c, kind in columns.items()
            ]
        ),
        "q_nunique_profile": _union(
            [
                f"select '{_table_label(t)}' as table_name, '{c}' as column_name, count(distinct {c}) as n_unique from {t}"
                for t, columns in NUNIQUE.items()
                for c in columns
            ]
        ),
        "q_value_counts": _union(
            _level_counts("fx_demo", DEMOGRAPHICS) + _level_counts("coupon_items", ["brand", "brand_type", "category"])
        ),
        "q_class_distribution": """
            select redemption_status, count(*) as n, count(*) / cast(sum(count(*)) over () as double) as share
            from fx_train group by redemption_status""",
        "q_positive_rate": """
            select sum(redemption_status) * cast(100 as double) / count(redemption_status) as positive_rate_pct from fx_train""",
        "q_describe": _union([_describe(c) for c in ["customer_id", "item_id", "quantity", *AMOUNTS]]),
        "q_quantile": _union([_quantile(c) for c in ["quantity", *AMOUNTS]]),
        "q_skewness": _union(
            [_skewness("selling_price", "selling_price"), _skewness("selling_price_log", "ln(1 + selling_price)")]
        ),
        "q_corr": _union(
            _correlations("fx_trans", AMOUNTS)
            + _correlations(
                f"(select {_uniform('score_a')} as score_a, {_uniform('score_b')} as score_b from fx_test)",
                ["score_a", "score_b"],
            )
        ),
        "q_histogram": _union(
            [
                _histogram("selling_price", "fx_trans", "selling_price", 50),
                _histogram("other_discount_log", "fx_trans", "ln(1 + other_discount * other_discount)", 50),
                _histogram("quantity", "fx_trans", "quantity", 10),
            ]
        ),
        "q_category_counts": "select category, count(*) as n from coupon_items where category is not null group by category",
        "q_sorted_distinct": "select distinct coupon_id from fx_train order by coupon_id",
        "q_campaign_levels": _union(
            ["select distinct 'offered' as column_name, cast(campaign_id as varchar) as level, cast(1 as bigint) as n from fx_train"]
            + _level_counts("fx_train", ["campaign_id"])
            + _level_counts("fx_campaign", ["campaign_type"])
        ),
        "q_topk_items": """
            select item_id, count(*) as n from fx_trans group by item_id order by n desc, item_id limit 15""",
        "q_frequent_items": """
            select item_id, count(*) as n from fx_trans group by item_id order by n desc, item_id limit 15""",
        "q_frequent_categories": """
            select category, count(*) as n from coupon_items where category is not null
            group by category order by n desc, category limit 10""",
        "q_ids_only_train": _union(
            [f"select '{k}' as key_name, {k} as key_value from (select {k} from fx_train except select {k} from fx_test)" for k in KEYS]
        ),
        "q_ids_common": _union(
            [f"select '{k}' as key_name, {k} as key_value from (select {k} from fx_train intersect select {k} from fx_test)" for k in KEYS]
        ),
        "q_customer_overlap": """
            select count(*) as n_common
            from (select customer_id from fx_trans intersect select customer_id from fx_demo)""",
        "q_parse_dates": """
            select o_orderkey, cast(strptime(t, '%d/%m/%Y') as date) as day_first,
              cast(coalesce(try_strptime(t, '%m/%d/%Y'), try_strptime(t, '%d/%m/%Y')) as date) as month_first,
              cast(strptime(s, '%d/%m/%y') as date) as short_year,
              try_strptime(t, '%Y-%m-%d') is null as other_format_fails
            from (select o_orderkey, strftime(o_orderdate, '%d/%m/%Y') as t, strftime(o_orderdate, '%d/%m/%y') as s
                  from orders)""",
        "q_durations": """
            select id, abs(date_diff('day', start_date, end_date)) as campaign_duration,
              abs(date_diff('day', start_date, trans_date)) as trans_duration from impression_dates""",
        "q_date_parts": "select id, "
        + ", ".join(f"{p}({c}_date) as {c}_{p}" for c in ("start", "end", "trans") for p in ("year", "month"))
        + " from impression_dates",
        "q_log_price": """
            select customer_id, item_id, selling_price, round(ln(1 + selling_price), 6) as selling_price_log from fx_trans""",
        "q_log_discounts": """
            select customer_id, item_id, round(ln(1 + other_discount * other_discount), 6) as other_discount_log,
              round(ln(1 + coupon_discount * coupon_discount), 6) as coupon_discount_log from fx_trans""",
        "q_impute_demographics": IMPUTED,
        "q_blend": f"""
            select id, a as score_a, b as score_b, 0.5 * a + 0.5 * b as score
            from (select id, {_uniform('score_a')} as a, {_uniform('score_b')} as b from fx_test)""",
        "q_label_encode": "select id, "
        + ", ".join(f"{_code(c)} as {code}" for c, (code, _) in CODES.items())
        + " from star_clean",
        "q_onehot_full": "select id, " + ", ".join(_is(c, v, f"{c}_{v}") for c, v in one_hot) + " from star_clean",
        "q_onehot_drop_first": "select customer_id, "
        + ", ".join(_is(c, v, f'"{p}_{v}"') for c, (p, values) in DUMMY_LEVELS.items() for v in values)
        + f" from ({IMPUTED})",
        "q_category_bins": f"""
            select item_id, case when code in (3, 7) then cast(code as varchar) when code is not null then 'other' end as brand_bin
            from (select item_id, {_code('brand')} as code from fx_item)""",
        "q_code_table": "select item_id, dense_rank() over (order by item_id) - 1 as item_code from (select distinct item_id from fx_trans)",
        "q_feature_table": _feature_table(),
        "q_holdout_split": f"""
            select id, case when {_hash('holdout')} < 1073741824 then 'val' else 'train' end as split from fx_train""",
        "q_holdout_classes": f"""
            select redemption_status as label, cast(2 as bigint) as n_cells, count(*) as n from fx_train
            where {_hash('holdout')} < 1073741824 group by redemption_status""",
        "q_kfold": f"select id, {_hash('fold')} % 10 as fold from fx_train",
        "q_key_set_sizes": _union(
            [
                f"""select '{k}' as column_name, (select count(distinct {k}) from fx_train) as n_left,
                  (select count(distinct {k}) from fx_test) as n_right,
                  (select count(distinct {k}) from fx_impression) as n_union,
                  (select count(*) from (select {k} from fx_train intersect select {k} from fx_test) i) as n_both,
                  (select count(*) from (select {k} from fx_train except select {k} from fx_test) l) as n_only_left,
                  (select count(*) from (select {k} from fx_test except select {k} from fx_train) r) as n_only_right,
                  cast(0 as double) as error_bound"""
                for k in ("campaign_id", "coupon_id", "customer_id")
            ]
        ),
        "q_customer_activity": """
            select customer_id, n_transactions, coalesce(quantity, 0) as quantity, coalesce(n_offers, 0) as n_offers,
              coalesce(n_test_offers, 0) as n_test_offers, cast(income_bracket as double) as income_bracket
            from (select customer_id, count(*) as n_transactions, cast(sum(quantity) as bigint) as quantity
                  from fx_trans group by customer_id) t
            left join (select customer_id, count(*) as n_offers, count(*) filter (source = 'test') as n_test_offers
                       from fx_impression group by customer_id) o using (customer_id)
            left join fx_demo using (customer_id)""",
        "q_dictionary_versions": """
            select 'customer_id' as column_name, cast(customer_id as varchar) as level,
              row_number() over (order by customer_id) - 1 as code, 1 as version from (select distinct customer_id from fx_demo)
            union all select 'age_range', age_range, row_number() over (order by age_range) - 1, 1
            from (select distinct age_range from fx_demo)
            union all select 'customer_id', cast(customer_id as varchar),
              row_number() over (order by customer_id) - 1 + (select count(distinct customer_id) from fx_demo), 2
            from (select customer_id from fx_trans except select customer_id from fx_demo)""",
        "q_dictionary_unknown": """
            select 'customer_id' as column_name, count(distinct customer_id) filter (code < 0) as n_levels,
              count(*) filter (code < 0) as n_rows, count(*) filter (code < 0) as n_other,
              cast(sum(code) as bigint) as sum_codes, max(code) as max_code
            from (select customer_id, coalesce(code, -1) as code from fx_trans left join (
              select customer_id, row_number() over (order by customer_id) - 1 as code
              from (select distinct customer_id from fx_demo)) c using (customer_id)) t""",
        "q_reject_counts": """
            with o as (
              select o_orderkey % 17 = 0 as short, o_orderkey % 5 = 0 as no_customer,
                o_orderkey % 7 = 0 or o_orderkey % 11 = 0 as bad_day, o_orderkey % 13 = 0 as bad_price from orders),
            r as (
              select '(row)' as column_name, 'number of values' as reason from o where short
              union all select 'customer_id', 'missing' from o where not short and no_customer
              union all select 'day', 'not of type date' from o where not short and bad_day
              union all select 'price', 'not of type double' from o where not short and bad_price
              union all select '(good)', '' from o where not (short or no_customer or bad_day or bad_price))
            select column_name, reason, cast(count(*) as bigint) as n from r group by column_name, reason""",
        "q_submission_file": f"select id, {_uniform('score_a')} as redemption_status, true as in_order from fx_test",
        "q_oof_rows": f"""
            select fold, count(*) as n_rows, count(distinct id) as n_ids, count(*) as n_in_range
            from (select id, {_hash('fold')} % 3 as fold from fx_train) group by fold""",
        "q_leaf_limit": "select cast(t as integer) as tree, true as within_limit, true as grown from unnest([0, 1]) as u(t)",
        "q_kfold_exact": f"select id, {ntile} as fold from fx_train",
        "q_kfold_stratified": f"select id, redemption_status, ({per_label}) % 10 as fold from fx_train",
        "q_fold_mean": f"""
            select id, avg({_uniform('fold_score', "cast(id as varchar) || ':' || cast(fold as varchar)")}) as score
            from fx_test, (select unnest(range(10)) as fold) group by id""",
        "q_roc_auc": f"""
            select dataset, sum(pos * (2 * below + neg)) / (cast(2 as double) * sum(pos) * sum(neg)) as auc
            from (select *, coalesce(sum(neg) over (partition by dataset order by score
                      rows between unbounded preceding and 1 preceding), 0) as below
                  from (select dataset, score, sum(label) as pos, sum(1 - label) as neg
                        from (select 'impressions' as dataset, redemption_status as label, {_uniform('score_a')} as score from fx_train
                              union all
                              select 'documents', quality, cast(n_chars as double)
                              from labels join documents using (doc_id))
                        group by dataset, score))
            group by dataset""",
        "q_confusion": f"""
            select label, prediction, (select count(*) from fx_train
              where redemption_status = label and cast({_uniform('score_a')} > 0.5 as int) = prediction) as n
            from (values (0, 0), (0, 1), (1, 0), (1, 1)) as cells(label, prediction)""",
    }


def oracle_sql() -> dict[str, str]:
    return {name: _sql(body) for name, body in _statements().items()}
