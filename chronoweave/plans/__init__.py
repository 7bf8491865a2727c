"""Whole analyses composed from operators: plain functions from DataFrames to named DataFrames."""

from chronoweave.plans.jobs import (
    activity_surface, bundles, corridor, daily_routines, encounters, exposure, fix_surface, grid_prism, observed_activities, origin_areas, path_prism,
    prism_intersections, road_prism, space_time_cube, stkde, temporal_misses, trajectory, two_anchor_prism)

JOBS = {
    "trajectory": trajectory,
    "stkde": stkde,
    "space_time_cube": space_time_cube,
    "path_prism": path_prism,
    "two_anchor_prism": two_anchor_prism,
    "grid_prism": grid_prism,
    "road_prism": road_prism,
    "origin_areas": origin_areas,
    "fix_surface": fix_surface,
    "activity_surface": activity_surface,
    "corridor": corridor,
    "exposure": exposure,
    "encounters": encounters,
    "temporal_misses": temporal_misses,
    "bundles": bundles,
    "daily_routines": daily_routines,
    "prism_intersections": prism_intersections,
    "observed_activities": observed_activities,
}
