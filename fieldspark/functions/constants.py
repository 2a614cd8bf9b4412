"""Physical constants. Fixed values, in SI units unless said otherwise."""

import math

pi = math.pi
deg_to_rad = pi / 180.0
rad_to_deg = 180.0 / pi
cpd = 1004.0  # heat capacity of dry air at constant pressure
cpv = 1850.0  # heat capacity of water vapour at constant pressure
Tf = 273.15  # freezing point of water
g = 9.81
Lv = 2.5104e6  # latent heats: vaporisation, fusion, sublimation
Lf = 0.3336e6
Ls = 2.844e6
Po = 1.0e5  # reference pressure
Rd = 287.04  # gas constants: dry air, water vapour
Rv = 461.5
esf = 611.0  # saturation vapour pressure at the freezing point
eps = 0.622
days_per_month = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
#: Default pressure levels, hPa.
plev_default = (10, 30, 50, 75, 100, 125, 150, 200, 250, 300, 350, 400, 450, 500, 550, 600, 650, 700, 750, 800, 825, 850, 875, 900, 925, 950, 975, 1000)

WGS84_A, WGS84_B = 6378137.0, 6356752.3142
AREA_RADIUS = 6.37122e6
