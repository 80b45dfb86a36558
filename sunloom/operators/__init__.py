"""DataFrame -> DataFrame operators on time axes, periods, forecasts and grids."""
