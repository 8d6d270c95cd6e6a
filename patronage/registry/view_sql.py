"""The business views of ``patronage.sources.views`` as SQL, for the side-by-side check."""

from __future__ import annotations

VIEWS = {
    "fx_transactions": """
        SELECT o_custkey AS customer_id, l_suppkey AS store_code,
               CASE WHEN l_returnflag = 'R' THEN 'Return' ELSE 'Purchase' END AS transaction_type,
               CASE WHEN l_returnflag = 'R' THEN CASE l_linenumber
                    WHEN 1 THEN 'Size Problem' WHEN 2 THEN 'Fit Problem' WHEN 3 THEN 'Zip Defect'
                    WHEN 4 THEN 'Adhesive' WHEN 5 THEN 'Gift Exchange' WHEN 6 THEN 'Color Exchange' END
               END AS return_reason,
               CAST(l_quantity AS INTEGER) AS item_count,
               CAST(CAST(l_quantity AS INTEGER) + l_linenumber % 3 AS INTEGER) AS units_sold,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS revenue,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))
                    AS DECIMAL(18,4)) AS discount,
               CAST(year(l_shipdate) AS INTEGER) AS year,
               CAST(floor((dayofyear(l_shipdate) + 6 - (isodow(l_shipdate) - 1)) / 7) AS INTEGER) AS week
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_customers": """
        SELECT c_custkey AS customer_id,
               CASE WHEN c_custkey % 9 <> 0 THEN '15MAR1980:00:00:00' END AS birth_date_raw,
               CASE WHEN c_custkey % 17 <> 0
                    THEN upper(strftime(last_order, '%d%b%Y:%H:%M:%S')) END AS last_accr_raw,
               CASE WHEN c_custkey % 23 = 0 THEN NULL
                    WHEN c_custkey % 19 = 0 THEN 'Unspecified' ELSE n_name END AS nationality,
               CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS job_type,
               CASE WHEN c_custkey % 4 = 0 THEN 'Unknown' ELSE c_mktsegment END AS income_range,
               CAST(c_acctbal AS DECIMAL(18,2)) AS points,
               n_name AS state
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey) latest
               ON c_custkey = o_custkey""",
    "fx_stores": """
        SELECT s_suppkey AS store_code, concat('MX - ', r_name) AS region,
               CASE WHEN s_suppkey % 3 = 0 THEN 'STANDALONE'
                    ELSE concat('MALL ', CAST(s_suppkey % 7 AS VARCHAR)) END AS mall_name,
               DATE '2010-01-01' + CAST(s_suppkey % 1000 AS INTEGER) AS store_launch_date,
               CAST(s_acctbal AS DECIMAL(18,2)) AS total_revenue,
               CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE) / 30 AS sales_per_day,
               CAST((s_suppkey % 5) * 100 AS INTEGER) AS store_size_sq_ft,
               CASE WHEN s_suppkey > (SELECT max(s_suppkey) FROM supplier) - 4
                    THEN 'Test' ELSE 'Train' END AS train_test_store
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "fx_test_pairs": """
        SELECT c_custkey AS customer_id, CAST(s_suppkey AS VARCHAR) AS store_code
        FROM customer JOIN supplier ON s_suppkey > (SELECT max(s_suppkey) FROM supplier) - 4""",
    "fx_bookings": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               concat('member-', CAST(o_custkey AS VARCHAR)) AS memberid,
               CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 1 END AS is_train,
               CAST(o_orderdate AS DATE) AS booking_date,
               CAST(l_shipdate AS DATE) AS checkin_date,
               CAST(l_shipdate AS DATE) + l_linenumber AS checkout_date,
               l_linenumber - 1 AS roomnights,
               CAST(l_quantity AS INTEGER) % 7 AS total_pax,
               CAST(l_quantity AS INTEGER) % 4 AS numberofadults,
               CAST(l_quantity AS INTEGER) % 3 AS numberofchildren,
               CASE WHEN l_partkey % 11 <> 0 THEN CAST(l_partkey % 4 AS INTEGER) END AS season_holidayed_code,
               CASE WHEN o_custkey % 12 <> 0 THEN CAST(o_custkey % 25 AS INTEGER) END AS state_code_residence,
               CAST(l_suppkey % 25 AS INTEGER) AS state_code_resort,
               CAST(l_suppkey % 3 AS INTEGER) AS resort_region_code,
               CAST(l_suppkey % 4 AS INTEGER) AS resort_type_code,
               CAST(o_custkey % 6 AS INTEGER) AS cluster_code,
               CAST(o_custkey % 5 AS INTEGER) AS member_age_buckets,
               CAST(l_partkey % 4 AS INTEGER) AS room_type_booked_code,
               o_orderstatus AS reservationstatusid_code,
               CASE WHEN l_orderkey % 5 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    # derived views, each named after the plan step it mirrors
    "v_enriched_all": """
        SELECT t.*, coalesce(return_reason, 'No Return') AS reason_filled,
               CASE WHEN year(monday) = year THEN monday END AS week_start_raw
        FROM (SELECT *, make_date(year, 1, 1) + CAST((8 - isodow(make_date(year, 1, 1))) % 7 AS INTEGER)
                        + 7 * (week - 1) AS monday
              FROM fx_transactions) t""",
    "v_enriched": """
        SELECT *, CASE WHEN week_start IS NULL THEN 'NA-NA'
                       ELSE concat(CAST(year(week_start) AS VARCHAR), '-', CAST(quarter(week_start) AS VARCHAR))
                  END AS year_quarter,
               strftime(week_start, '%Y-%m') AS y_m
        FROM (
          SELECT t.customer_id, t.store_code, s.region, s.store_format, s.sales_per_day, c.state, c.points,
               c.nationality_group,
               transaction_type, reason_filled AS return_reason,
               CASE WHEN reason_filled IN ('Size Problem', 'Ordered wrong size', 'Fit Problem') THEN 'Size.Problem'
                    WHEN reason_filled IN ('Mfg. Defect', 'Adhesive', 'Accessory/Trim', 'Zip Defect', 'Warranty',
                         'Squins/Button Detachment', 'Handling Defect', 'Motif/Print Defect',
                         'Material/Fabric Defect', 'Appearance Change After wash') THEN 'Mfg.Defect'
                    WHEN reason_filled IN ('Gift Exchange', 'Color Exchange') THEN 'Others'
                    ELSE reason_filled END AS return_group,
               year, week,
               CASE WHEN week_start_raw IS NOT NULL THEN week_start_raw
                    WHEN year = 1997 AND week = 0 THEN DATE '1997-01-06' END AS week_start,
               item_count, units_sold, revenue, discount,
               CASE WHEN transaction_type = 'Return' THEN 1 ELSE 0 END AS is_return,
               units_sold - item_count AS extra_items,
               revenue + discount AS gross
          FROM v_enriched_all t
          JOIN (SELECT store_code, replace(region, 'MX - ', '') AS region,
                       CASE WHEN mall_name = 'STANDALONE' THEN 'Stand Alone Store' ELSE 'Mall Store' END
                       AS store_format, sales_per_day FROM fx_stores) s ON t.store_code = s.store_code
          JOIN (SELECT customer_id, state, points,
                       CASE WHEN n < 60 THEN 'Others' WHEN nationality = 'Unspecified' THEN 'UNDEFINED'
                            ELSE nationality END AS nationality_group
                FROM (SELECT *, count(*) OVER (PARTITION BY nationality) AS n FROM fx_customers)) c
            ON t.customer_id = c.customer_id
          WHERE year IN (1996, 1997))""",
    "v_rfm": """
        SELECT r.customer_id, recency, frequency, monetary
        FROM (SELECT customer_id, coalesce(days, max(days) OVER ()) AS recency
              FROM (SELECT customer_id, max(d) OVER () + 1 - d AS days
                    FROM (SELECT customer_id,
                                 CAST(strptime(split_part(last_accr_raw, ':', 1), '%d%b%Y') AS DATE) AS d
                          FROM fx_customers))) r
        LEFT JOIN (SELECT customer_id,
                          CAST(sum(CASE WHEN transaction_type = 'Return' THEN -item_count ELSE item_count END)
                               AS BIGINT) AS frequency,
                          sum(revenue) AS monetary
                   FROM fx_transactions GROUP BY customer_id) a ON r.customer_id = a.customer_id""",
    "v_scored": """
        SELECT b.*, tr.r, tf.f, tm.m, 100 * tr.r + 10 * tf.f + tm.m AS rfm_code,
               (tr.r + tf.f + tm.m) / 3.0::DOUBLE AS agg_score,
               CASE WHEN tr.r > 3 OR tf.f > 3 OR tm.m > 3 THEN 0 ELSE 1 END AS prediction
        FROM v_rfm b
        LEFT JOIN (SELECT customer_id, CAST(ntile(4) OVER (ORDER BY recency, customer_id) AS INTEGER) AS r
                   FROM v_rfm WHERE recency IS NOT NULL) tr ON b.customer_id = tr.customer_id
        LEFT JOIN (SELECT customer_id, CAST(ntile(4) OVER (ORDER BY frequency DESC, customer_id) AS INTEGER) AS f
                   FROM v_rfm WHERE frequency IS NOT NULL) tf ON b.customer_id = tf.customer_id
        LEFT JOIN (SELECT customer_id, CAST(ntile(4) OVER (ORDER BY monetary DESC, customer_id) AS INTEGER) AS m
                   FROM v_rfm WHERE monetary IS NOT NULL) tm ON b.customer_id = tm.customer_id""",
    "v_cleaned_bookings": """
        SELECT *,
               CASE WHEN people > 4 OR people < 2 THEN 'others' WHEN people = 2 THEN 'couple'
                    ELSE 'family' END AS pax,
               CASE WHEN roomnights <= 2 THEN 'VShort' WHEN roomnights <= 4 THEN 'Normal'
                    WHEN roomnights <= 7 THEN 'Week' WHEN roomnights > 7 THEN 'Long' END AS room_stay,
               CASE WHEN advance_booking <= 2 THEN 'Sudden' WHEN advance_booking <= 15 THEN 'Fortnite'
                    WHEN advance_booking <= 31 THEN 'Amonth' WHEN advance_booking > 31 THEN 'Long Booking'
               END AS adv_booking,
               CAST(month(booking_date) AS INTEGER) AS booking_month,
               CAST(day(booking_date) AS INTEGER) AS booking_day,
               CAST(month(checkin_date) AS INTEGER) AS checkin_month,
               CAST(day(checkin_date) AS INTEGER) AS checkin_day,
               dayname(booking_date) AS booking_d, dayname(checkin_date) AS checkin_d,
               dayname(checkout_date) AS checkout_d,
               isodow(checkin_date) >= 6 AS checkin_weekend
        FROM (SELECT * EXCLUDE (booking_date, roomnights, season_holidayed_code, state_code_residence),
                     CASE WHEN checkin_date < booking_date THEN checkin_date ELSE booking_date END AS booking_date,
                     CAST(CASE WHEN checkin_date < booking_date THEN 0 ELSE checkin_date - booking_date END
                          AS INTEGER) AS advance_booking,
                     CAST(CASE WHEN roomnights < 1 THEN checkout_date - checkin_date ELSE roomnights END
                          AS INTEGER) AS roomnights,
                     CAST(quarter(checkin_date) AS INTEGER) AS checkin_quarter,
                     CASE WHEN season_holidayed_code IS NOT NULL THEN season_holidayed_code
                          WHEN quarter(checkin_date) = 2 THEN 2 WHEN quarter(checkin_date) = 3 THEN 4
                          WHEN quarter(checkin_date) = 4 THEN 2 END AS season_holidayed_code,
                     coalesce(state_code_residence, 8) AS state_code_residence,
                     total_pax AS people
              FROM fx_bookings)""",
}


def sql(body: str) -> str:
    """``body`` preceded by the views it uses, directly or through another view."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in VIEWS.items():
            if name in needed or not _mentions(text, name):
                continue
            visit(definition)
            needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    return f"WITH {views}\n{body.strip()}"


def _mentions(text: str, name: str) -> bool:
    at = text.find(name)
    while at >= 0:
        end = at + len(name)
        if end == len(text) or not (text[end].isalnum() or text[end] == "_"):
            return True
        at = text.find(name, end)
    return False
