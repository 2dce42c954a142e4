"""Car and car-class reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetframe.functions import half_up_ratio, percent_of, usage_status
from fleetframe.plans.paging import top_rows
from fleetframe.plans.rollups import rental_counts_per_car, rentals_per_car
from fleetframe.sources.tables import RentalTables


def _classed_cars(tables: RentalTables) -> DataFrame:
    """Cars that belong to a known class, with the class name."""
    classes = tables.car_class.select("cc_id", "class_name")
    return tables.car.join(classes, F.col("car_class_cc_id") == F.col("cc_id"))


def _total_rentals(tables: RentalTables) -> Column:
    """All rows of the rental bridge, as a scalar subquery."""
    return tables.car_transaction.agg(F.count("*")).scalar()


def class_utilization(tables: RentalTables) -> DataFrame:
    """Rentals per class and their share of all rentals, most rented first."""
    per_class = (
        tables.car.select("car_id", "car_class_cc_id")
        .join(rental_counts_per_car(tables), F.col("car_id") == F.col("rented_car_id"))
        .groupBy("car_class_cc_id")
        .agg(F.sum("rentals").alias("rentals"))
    )
    rentals = F.coalesce(F.col("rentals"), F.lit(0))
    return (
        tables.car_class.join(per_class, F.col("cc_id") == F.col("car_class_cc_id"), "left")
        .select(
            "cc_id",
            F.col("class_name").alias("Class_Name"),
            rentals.alias("rental_count"),
            percent_of(rentals, _total_rentals(tables)).alias("utilization_percentage"),
        )
        .orderBy(F.desc("rental_count"), "cc_id")
        .drop("cc_id")
    )


def popular_classes(tables: RentalTables) -> DataFrame:
    """Cars, rentals, revenue, mean rate and share per class, most rented first.

    A car counts once per rental in the mean rate, and once if never rented.
    """
    bridge_rows = F.coalesce(F.col("bridge_rows"), F.lit(0))
    rentals = F.coalesce(F.col("rentals"), F.lit(0))
    weight = F.greatest(bridge_rows, F.lit(1))
    per_class = (
        tables.car.select("car_id", "car_price", "car_class_cc_id")
        .join(rentals_per_car(tables), F.col("car_id") == F.col("rented_car_id"), "left")
        .groupBy("car_class_cc_id")
        .agg(
            F.count("car_id").alias("cars"),
            F.sum(bridge_rows).alias("rentals"),
            F.sum("revenue").alias("revenue"),
            F.sum(F.col("car_price") * weight.cast("decimal(15,0)")).alias("rates"),
            F.sum(F.when(F.col("car_price").isNotNull(), weight)).alias("rated"),
        )
    )
    return (
        tables.car_class.join(per_class, F.col("cc_id") == F.col("car_class_cc_id"), "left")
        .select(
            "cc_id",
            F.col("class_name").alias("Class_Name"),
            F.coalesce("cars", F.lit(0)).alias("Total_Cars_In_Class"),
            rentals.alias("Total_Rentals"),
            F.col("revenue").alias("Class_Revenue"),
            half_up_ratio(F.col("rates"), F.col("rated"), 2).alias("Average_Daily_Rate"),
            percent_of(rentals, _total_rentals(tables)).alias("Popularity_Percentage"),
        )
        .orderBy(F.desc("Total_Rentals"), "cc_id")
        .drop("cc_id")
    )


def _car_rentals(tables: RentalTables) -> DataFrame:
    return (
        _classed_cars(tables)
        .join(rentals_per_car(tables), F.col("car_id") == F.col("rented_car_id"), "left")
        .withColumn("rentals", F.coalesce("rentals", F.lit(0)))
    )


def vehicle_utilization(tables: RentalTables, k: int | None = 15) -> DataFrame:
    """Cars by revenue; cars without revenue come last."""
    ranked = top_rows(_car_rentals(tables), [F.desc("revenue"), F.asc("car_id")], k)
    return ranked.select(
        F.col("car_id").alias("Car_ID"),
        F.col("car_name").alias("Car_Name"),
        F.col("class_name").alias("Class_Name"),
        F.col("car_price").alias("Car_Price"),
        F.col("rentals").alias("Rental_Count"),
        F.col("revenue").alias("Total_Revenue"),
        half_up_ratio(F.col("revenue"), F.col("amounts"), 2).alias("Average_Revenue_Per_Rental"),
        percent_of(F.col("rentals"), _total_rentals(tables)).alias("Utilization_Percentage"),
    )


def car_usage(tables: RentalTables, k: int | None = 20) -> DataFrame:
    """Cars by revenue (0 if none) with a usage label."""
    earned = _car_rentals(tables).withColumn("revenue", F.coalesce("revenue", F.lit(0)))
    ranked = top_rows(earned, [F.desc("revenue"), F.asc("car_id")], k)
    return ranked.select(
        F.col("car_id").alias("Car_ID"),
        F.col("car_name").alias("Car_Name"),
        F.col("class_name").alias("Class_Name"),
        F.col("car_price").alias("Car_Price"),
        F.col("rentals").alias("Rental_Count"),
        F.col("revenue").alias("Total_Revenue"),
        usage_status(F.col("rentals")).alias("Usage_Status"),
    )


def fleet_list(tables: RentalTables) -> DataFrame:
    """Every classed car, by class and price."""
    return _classed_cars(tables).select(
        F.col("car_id").alias("Car_ID"),
        F.col("car_name").alias("Car_Name"),
        F.col("car_type").alias("Car_Type"),
        F.col("car_price").alias("Car_Price"),
        F.col("class_name").alias("Class_Name"),
    ).orderBy("Class_Name", "Car_Price", "Car_ID")


def cars_by_class(tables: RentalTables) -> DataFrame:
    """Number of cars and price range per class, largest class first."""
    per_class = tables.car.groupBy("car_class_cc_id").agg(
        F.count("car_id").alias("cars"),
        F.sum("car_price").alias("prices"),
        F.count("car_price").alias("priced"),
        F.min("car_price").alias("lowest"),
        F.max("car_price").alias("highest"),
    )
    return (
        tables.car_class.join(per_class, F.col("cc_id") == F.col("car_class_cc_id"), "left")
        .select(
            "cc_id",
            F.col("class_name").alias("Class_Name"),
            F.coalesce("cars", F.lit(0)).alias("Total_Cars"),
            half_up_ratio(F.col("prices"), F.col("priced"), 0).alias("Average_Price"),
            F.col("lowest").alias("Min_Price"),
            F.col("highest").alias("Max_Price"),
        )
        .orderBy(F.desc("Total_Cars"), "cc_id")
        .drop("cc_id")
    )


def fleet_stats(tables: RentalTables) -> DataFrame:
    """One row: cars, classes in use, mean price, cars above the unrounded mean price."""
    mean_price = tables.car.agg(
        half_up_ratio(F.sum("car_price"), F.count("car_price"), 10)
    ).scalar()
    return tables.car.agg(
        F.count("*").alias("Total_Cars"),
        F.countDistinct("car_class_cc_id").alias("Total_Classes"),
        half_up_ratio(F.sum("car_price"), F.count("car_price"), 0).alias("Average_Price"),
        F.count(F.when(F.col("car_price") > mean_price, 1)).alias("Premium_Cars"),
    )


def rental_stats(tables: RentalTables) -> DataFrame:
    """One row: cars ever rented, rentals, revenue over all rentals (0 if none)."""
    return rentals_per_car(tables).agg(
        F.count("rented_car_id").alias("Cars_Ever_Rented"),
        F.coalesce(F.sum("rentals"), F.lit(0)).alias("Total_Rentals"),
        F.coalesce(F.sum("revenue"), F.lit(0)).alias("Total_Fleet_Revenue"),
    )
